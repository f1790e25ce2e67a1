"""Licence scans by sentence rules: sentences are mapped to identifiers, and sequences of these are matched by ordered rules."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import map_texts, read

#: Identifiers of known licence sentences and the pattern that a normalised sentence must match as a whole.
SENTENCES = {
    "mit-name": r"(this (work|software|project|file|code) is )?(released|licen[sc]ed|distributed|available) under (the )?(terms of the )?mit licen[sc]e",
    "mit-grant": r"permission is hereby granted, free of charge, to any person obtaining a copy .*",
    "mit-notice": r"the above copyright notice and this permission notice shall be included in all copies .*",
    "mit-warranty": r'the software is provided "?as is"?, without warranty of any kind.*',
    "apache-2-name": r"(this (work|software|project|file|code) is )?(released|licen[sc]ed|distributed) under (the )?(terms of the )?apache licen[sc]e,? (version )?2(\.0)?( \(the \"licen[sc]e\"\))?",
    "apache-2-comply": r"you may not use this file except in compliance with the licen[sc]e",
    "gpl-name-version": r"(this (work|software|program|project|file|code) is )?(released|licen[sc]ed|distributed) under (the )?(terms of the )?(gnu general public licen[sc]e|(gnu )?gpl),? ?(version |v ?)?(?P<gpl>[123])(\.0)?(?P<later>,? or (\(at your option\) )?(any )?later( version)?)?",
    "gpl-free": r"this program is free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e .*",
    "gpl-version": r"(.* )?either version (?P<gplv>[123](\.\d)?) of the licen[sc]e, or \(at your option\) any later version",
    "lesser-free": r"this (program|library) is free software[:;] you can redistribute it and/or modify it under the terms of the gnu (lesser|library) general public licen[sc]e .*",
    "affero-free": r"this program is free software[:;] you can redistribute it and/or modify it under the terms of the gnu affero general public licen[sc]e .*",
    "lgpl-name": r"(this \w+ is )?(released|licen[sc]ed|distributed) under (the )?(terms of the )?gnu (lesser|library) general public licen[sc]e.*",
    "bsd-redistribute": r"redistribution and use in source and binary forms, with or without modification, are permitted .*",
    "bsd-source": r"(\d[.)] ?)?redistributions of source code must retain the above copyright notice.*",
    "bsd-binary": r"(\d[.)] ?)?redistributions in binary form must reproduce the above copyright notice.*",
    "bsd-endorse": r"(\d[.)] ?)?neither the name of .* may be used to endorse or promote products.*",
    "cc-name": r"(this (work|document|text|article) is )?(released|licen[sc]ed) under (a |the )?(creative commons|cc)[ -](?P<cc>by(-(nc|sa|nd))*)( licen[sc]e)?,? ?(?P<ccv>\d\.\d)?( international)?( licen[sc]e)?",
    "cc0-name": r"(this \w+ is )?(released|dedicated|licen[sc]ed) (under|to) (the )?(cc0|public domain)( 1\.0)?.*",
    "mpl-name": r"this source code form is subject to the terms of the mozilla public licen[sc]e, v\. ?2\.0",
    "isc-grant": r"permission to use, copy, modify,? (and|and/or) distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": r"permission to use, copy, modify,? (and|and/or) distribute this software for any purpose with or without fee is hereby granted(?!,? provided)",
    "zlib-grant": r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.*",
    "boost-grant": r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation .*",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "epl-name": r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e,? (version |v\. ?|v)?(?P<epl>[12]\.0).*",
    "all-rights": r"all rights reserved",
    "copyright": r"(copyright|\(c\)|©) .*\d{4}.*",
}

#: Ordered rules; the first whose identifiers follow one another, with up to GAP sentences between two, claims them.
RULES = (
    (("mit-grant", "mit-notice", "mit-warranty"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-redistribute", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("apache-2-name", "apache-2-comply"), "Apache-2.0"),
    (("gpl-free", "gpl-version"), "GPL-{gplv}-or-later"),
    (("lesser-free", "gpl-version"), "LGPL-{gplv}-or-later"),
    (("affero-free", "gpl-version"), "AGPL-{gplv}-or-later"),
    (("gpl-name-version",), "GPL-{gpl}.0{later}"),
    (("gpl-free",), "GPL"),
    (("lesser-free",), "LGPL"),
    (("affero-free",), "AGPL"),
    (("lgpl-name",), "LGPL"),
    (("apache-2-name",), "Apache-2.0"),
    (("mit-name",), "MIT"),
    (("cc-name",), "CC-{cc}-{ccv}"),
    (("cc0-name",), "CC0-1.0"),
    (("mpl-name",), "MPL-2.0"),
    (("isc-grant",), "ISC"),
    (("0bsd-grant",), "0BSD"),
    (("zlib-grant",), "Zlib"),
    (("boost-grant",), "BSL-1.0"),
    (("unlicense",), "Unlicense"),
    (("epl-name",), "EPL-{epl}"),
    (("spdx",), "{spdx}"),
    (("copyright", "all-rights"), "Proprietary"),
    (("all-rights",), "Proprietary"),
)
GAP = 2
HEAD = ("copyright", "all-rights")
#: Every pattern implies one of these, on whatever lines its words stand.
WORDS_OF_INTEREST = re.compile(r"licen[sc]|\bgpl|reserved|redistribut|permission|warrant|copyright|\(c\)|©|cc0|\bcc\b|creative|domain|endorse", re.IGNORECASE)
#: A full stop ends a sentence, but not in `v. 2.0` nor after a list's number.
END = re.compile(r"(?:(?<!\bv)\.|(?<=\bv)\.(?!\s*\d)|[!?])(?=\s|$)|;(?=\s)|\n", re.IGNORECASE)
NUMBER = re.compile(r"[\s#*/;>%\-]*\d{1,2}\.")
DECORATION = re.compile(r"^[\s#*/;>%\-]+|[\s*/]+$")
CLOSING = ".!?,;: "
#: A notice of one line, whose pattern would take in any line with a year after it.
ONE_LINE = "copyright"
#: Words with which known sentences may also begin amid a line, as where a whole notice stands on one.
AMID = {
    "mit-grant": "permission is hereby granted", "mit-notice": "the above copyright notice and this permission notice", "mit-warranty": "the software is provided",
    "apache-2-name": "licen[sc]ed under the apache", "apache-2-comply": "you may not use this file", "bsd-redistribute": "redistribution and use in source",
    "isc-grant": "permission to use, copy, modify", "0bsd-grant": "permission to use, copy, modify", "zlib-grant": "permission is granted to anyone", "boost-grant": "permission is hereby granted",
    "unlicense": "this is free and unencumbered", "epl-name": "this program and the accompanying materials",
    "lesser-free": "this (program|library) is free software", "affero-free": "this program is free software", "gpl-free": "this program is free software", "gpl-version": "either version", "mpl-name": "this source code form is subject",
}
#: A tag of one line whose value is an expression over identifiers; exceptions are no licences.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.IGNORECASE)
SPDX_ID = re.compile(r"(?<!WITH )(?<![\w.+-])(?!(?:AND|OR|WITH|NONE|NOASSERTION)\b)[A-Za-z][\w.-]*\+?")


@lru_cache(maxsize=1)
def patterns() -> list[tuple[str, re.Pattern, bool]]:
    """(identifier, pattern, whether anything may follow); of the latter the pattern is the least that must be there."""
    got = []
    for name, p in SENTENCES.items():
        is_open = p.endswith(".*")
        got.append((name, re.compile(p.removesuffix(".*").replace(".*", ".*?") if is_open else p, re.DOTALL), is_open))
    return got


def sentences(text: str) -> list[list[tuple[int, int]]]:
    """The sentences, each as from and to of its pieces: its lines, cut at semicolons too, as notices may begin there.

    A sentence ends at a full stop before white space, at a line without words and at the text's end.
    """
    made, pieces, at = [], [], 0
    for m in [*END.finditer(text), None]:
        if m and m[0] == "." and NUMBER.fullmatch(text, at, m.end()):
            continue
        stop = len(text) if m is None else m.start() if m[0] == "\n" else m.end()
        wordless = not plain(text[at:stop]).strip(CLOSING)
        if not wordless:
            pieces.append((at, stop))
        # what is left of a line after its last mark is no empty line
        empty = wordless and m is not None and m[0] == "\n" and (at == 0 or text[at - 1] == "\n")
        if pieces and (m is None or empty or m[0] in ".!?"):
            made.append(pieces)
            pieces = []
        at = stop if m is None else m.end()
    return made


def plain(piece: str) -> str:
    return " ".join(DECORATION.sub("", piece.translate({0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'"})).lower().split())


def identify(text: str) -> list[tuple[int, int, int, str, dict]]:
    """(sentence number, from, to, identifier, named parts) of every known sentence; one may lie inside a longer one."""
    found = []
    for n, pieces in enumerate(sentences(text)):
        words = [plain(text[a:b]) for a, b in pieces]
        joined = " ".join(words)
        ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
        starts = [e - len(w) for e, w in zip(ends, words, strict=True)]
        hits = []  # first piece, last piece, identifier, named parts, open
        amid = {(bisect_left(ends, m.start() + 1), m.start(), name) for name, begins in AMID.items() for m in re.finditer(rf"\b{begins}", joined)}
        for i, start, only in sorted({(i, start, "") for i, start in enumerate(starts)} | {a for a in amid if a[1] not in starts}):
            for name, pattern, is_open in patterns():
                if only not in ("", name):
                    continue
                m = pattern.match(joined, start, ends[i] if name == ONE_LINE else len(joined))
                if not m:
                    continue
                last = bisect_left(ends, m.end() - (joined[m.end() - 1] == " "))
                if is_open:
                    hits.append((i, last, name, m.groupdict(), name != ONE_LINE))
                    continue
                for j in range(i, last + 1):
                    m = pattern.fullmatch(joined, start, start + len(joined[start : ends[j]].rstrip(CLOSING)))
                    if m:
                        hits.append((i, j, name, m.groupdict(), False))
                        break
        for i, j, name, parts, is_open in hits:
            if is_open:  # up to what is known next
                j = max(j, min((h[0] - 1 for h in hits if h[0] > i), default=len(pieces) - 1))
            a, b = pieces[i][0], pieces[j][1]
            found.append((n, a + len(text[a:b]) - len(text[a:b].lstrip()), b, name, parts))
    return found


def claims(known: list[tuple[int, int, int, str, dict]]) -> list[tuple[str, int, int]]:
    """(licence, from, to) in order of place, from known sentences. Each belongs to one licence at most.

    A copyright line and `all rights reserved` at the head of another licence say nothing else and belong to that one.
    """
    free = [True] * len(known)
    out = []
    for names, licence in RULES:
        for i in range(len(known)):
            took = []
            for j in range(i, len(known)):
                if took and max(known[j][0] - known[took[-1]][0], j - took[-1]) > GAP + 1:
                    break
                if free[j] and known[j][3] == names[len(took)]:
                    took.append(j)
                    if len(took) == len(names):
                        break
                elif not took:
                    break
            if len(took) == len(names):
                parts = {k: "-or-later" if k == "later" else f"{v}.0" if k == "gplv" and "." not in v else v for j in took for k, v in known[j][4].items() if v}
                for j in took:
                    free[j] = False
                if names == HEAD and any(0 <= first - known[took[-1]][0] <= GAP + 1 and start > known[took[-1]][1] for first, start in ((o[3], o[1]) for o in out if o[0] != licence)):
                    continue
                name = re.sub(r"\{(\w+)\}", lambda m, p=parts: p.get(m[1], "").upper() if m[1] == "cc" else p.get(m[1], ""), licence).rstrip("-")
                out.append((name, known[took[0]][1], max(known[j][2] for j in took), known[took[0]][0]))
    return sorted((x[:3] for x in out), key=lambda x: (x[1], x[2], x[0]))


def tags(text: str) -> list[tuple[int, int, int, str, dict]]:
    """Identifiers of licence tags, each as a sentence of its own before all others."""
    found = [(m, i) for m in SPDX.finditer(text) for i in SPDX_ID.findall(m[1])]
    return [(-1, m.start(), m.end(), "spdx", {"spdx": i.removesuffix("+") + "-or-later" * i.endswith("+")}) for m, i in found]


def known_sentences(text: str | None) -> list[tuple[int, int, int, str, dict]]:
    return [*tags(text), *identify(text)] if text and WORDS_OF_INTEREST.search(text) else []


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(licence, from, to) in order of place. Each known sentence belongs to one licence at most."""
    return claims(known_sentences(text))


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, licences (distinct names in order), spans (name, start, stop in code points) and n_sentences known, in a licence or not.

    Null and empty texts have none. Repeated rows and null ids pass through, other columns are ignored, an empty table
    gives an empty table.
    """
    span = pa.struct([("licence", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(texts: list) -> dict[str, list]:
        known = [known_sentences(t) for t in texts]
        found = [claims(k) for k in known]
        return {
            "licences": pa.array([list(dict.fromkeys(x[0] for x in f)) for f in found], pa.list_(pa.string())),
            "spans": pa.array([[dict(zip(("licence", "start", "stop"), x, strict=True)) for x in f] for f in found], pa.list_(span)),
            "n_sentences": [len(k) for k in known],
        }

    return map_texts(docs, run, "licences array<string>, spans array<struct<licence:string,start:int,stop:int>>, n_sentences long", (doc_id,), text)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"))
