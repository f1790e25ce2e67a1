"""The corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import bpe_stream, chat, exact_dedup, language, licences, line_rules, near_dedup, packing, quality, queries, tokens
from quern.llm.common import package_path
from quern.llm.components import components
from tests.compare import agree
from tests.conftest import DATA

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(9000))
BASE = " ".join(f"word{i}" for i in range(200))
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, "Hello World", "en", "a"), (4, "hello world", "en", "a"), (5, LONG, "en", "b"), (6, "   \n\t ", "de", "b"),
    (7, BASE, "en", "b"), (8, BASE + " more", "en", "b"), (9, "x " + BASE + " more", "en", "b"), (9, "x " + BASE + " more", "en", "b"), (None, "Hello World", "en", None),
    (10, "ÀÉ é É", "fr", "c"), (11, "àÉ é É", "fr", "c"), (12, "a b c d", "en", "c"), (13, "A B c d", "en", "c"), (14, "<|endoftext|> [INST] \\ </s>", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that clash with what the operators make, too."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("row", "score", "kept", "id", "n_tokens", "component", "class", "task", "key", "ids", "gone", "kept_id", "kept_digest", "tk", "bucket", "comp", "grp", "rank", "quern", "quern_sha")})


def test_empty_tables(docs):
    none = docs.limit(0)
    for df in (tokens.token_counts(none), bpe_stream.roundtrip_digests(none), exact_dedup.decisions(none), packing.pack(none), near_dedup.near_duplicates(none),
               line_rules.line_rules(none), licences.scan_licences(none), language.identify(none, language.learn(none)), quality.classify(none, quality.fit([]))):
        assert df.count() == 0


def test_token_counts(docs):
    library = Tokenizer.from_file(package_path("byte_bpe_50k.json"))
    got = collections.Counter(tuple(r) for r in tokens.token_counts(docs).collect())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in ROWS]
    assert got == collections.Counter((i, len((t or "").encode()), k, k > 512) for (i, t, _, _), k in zip(ROWS, n, strict=True))


def test_round_trip_digests(docs):
    library = Tokenizer.from_file(package_path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for i, t, _, _ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter(tuple(r) for r in bpe_stream.roundtrip_digests(docs).collect()) == want
    assert {r.doc_id: r.ids for r in bpe_stream.encode_texts(docs).collect()}[14] == library.encode(ROWS[-1][1], add_special_tokens=False).ids


def test_exact_dedup(docs):
    for share in (0.001, 0.2):  # all groups light, and some heavy
        rows = exact_dedup.decisions(docs, share).collect()
        groups = collections.defaultdict(list)
        for i, t, _, _ in ROWS:
            groups[(t or "").translate(LOWER)].append(i)
        assert len(rows) == len(ROWS)
        for text, ids in groups.items():
            mine = [r for r in rows if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
            best = max((i for i in ids if i is not None), default=None)
            assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in mine)
            assert {(r.keep_id, r.group_size) for r in mine} == {(best, len(ids))}
            assert [r.doc_id for r in mine if r.kept] == [best]
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    alone = docs.filter("doc_id IS NOT NULL AND doc_id <> 9")  # ids tell rows apart
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(alone).collect()) == [2, 4, 5, 6, 7, 8, 10, 11, 13, 14]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        if i is not None:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [256, 3])
def test_near_dedup(spark, docs, block):
    """A chain of texts in which neighbours are near and the ends are not; with small blocks it spans several."""
    words = [f"term{i}" for i in range(120)]
    chain = []
    for k in range(12):
        chain.append((100 + k, " ".join(words)))
        words = words[:]
        words[k * 9] = f"other{k}"
    more = docs.select("doc_id", "text").unionAll(spark.createDataFrame(chain, "doc_id long, text string"))
    got = near_dedup.near_duplicates(more, block=block).collect()
    want = brute_components([(i, t) for i, t, _, _ in ROWS] + chain)
    assert len(got) == len(ROWS) + len(chain)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert len({want[i] for i, _ in chain}) < len(chain)
    if block == 256:
        left = near_dedup.drop_near_copies(docs)
        assert left.columns == docs.columns and collections.Counter(r.doc_id for r in left.collect())[9] == 0 and left.filter("doc_id IS NULL").count() == 1


def test_near_dedup_between_the_limits(spark):
    """Pairs at 0.80 to 0.85 are one in the pipeline's stage and two in op8; a pair below 0.80 is two in both."""
    import corpus_pipeline

    rows = []
    for n in range(48, 68):  # one other word in the middle: (n - 9) / (n + 1) of the shingles are shared
        words = [f"p{n}w{k}" for k in range(n)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join([*words[:20], "other", *words[21:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = lambda percent: {2 * n + 1 for n in range(48, 68) if 100 * (n - 9) >= percent * (n + 1)}
    ids = {i for i, _ in rows}
    assert len(near(80)) == 19 and len(near(85)) == 2
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, DATA).collect()} == ids - near(80)
    assert {r.doc_id for r in near_dedup.near_duplicates(docs, percent=85).filter("kept").collect()} == ids - near(85)
    assert {r.doc_id for r in near_dedup.near_duplicates(docs).filter("kept").collect()} == ids - near(80)


def test_near_dedup_filters_follow_the_limit():
    assert near_dedup.bands_for(85) == (32, 6) and abs(near_dedup.look_from(85) - 0.70) < 1e-12
    for percent in (50, 70, 80, 85, 90, 100):
        bands, rows = near_dedup.bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS and bands * rows <= near_dedup.MINIMA
    least = near_dedup.look_from(80) * near_dedup.SKETCH
    assert sum(math.comb(128, k) * 0.8**k * 0.2 ** (128 - k) for k in range(math.ceil(least))) < 1e-5


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, 7), (201, 200), (202, 201), (202, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "high long, low long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200, 202: 200}


def test_line_rules_measures(spark):
    texts = [None, "", "a b", "x y\nx y\n\n x y", "#*a $b <c> é", "one two three four five six seven eight " * 3, LONG[:5000]]

    def brute(t):
        w, seen, dup = WORDS.findall(t or ""), set(), 0
        for line in (t or "").split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), failed

    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in line_rules.line_rules(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])


def test_line_frequency(spark):
    """A line of many documents of one host is removed there alone; copies of one document count once."""
    shared = " ".join(f"subscribe{k}" for k in range(30))
    own = lambda i: " ".join(f"u{i}n{k}" for k in range(30))
    rows = [(i, f"{shared}\n" + (own(i) if i % 2 else f"few {i}"), "one") for i in range(30)]
    rows += [(100 + i, f"{shared}\nfew {i}", "two") for i in range(3)]
    rows += [(200 + i, f"{own(999)}\n{own(998)}", "three") for i in range(40)]
    got = {r.doc_id: r for r in line_rules.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].removed_words == 30 and got[i].kept == bool(i % 2) for i in range(30))
    assert all(got[100 + i].removed_words == 0 and got[100 + i].kept for i in range(3))
    assert all(got[200 + i].removed_words == 0 and got[200 + i].kept for i in range(40))


def test_packing(docs):
    library = Tokenizer.from_file(package_path("word_bpe_49k.json"))
    twice = collections.Counter((r.start, r.length, r.ids_crc32) for r in packing.pack(docs.filter("doc_id = 9")).collect())
    assert twice and set(twice.values()) == {2}
    rows = packing.pack(docs.filter("doc_id IS NULL OR doc_id <> 9")).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _, _ in ROWS}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing_plan_wastes_little():
    sizes = collections.Counter()
    rng = __import__("random").Random(3)
    total = 0
    for _ in range(5000):
        n = int(rng.lognormvariate(6.9, 1)) + 1
        total += n
        sizes.update(-(-(b - a) // 4) for a, b in packing.cuts(n, 2048, 128))
    rows = packing.plan(sizes, 512)
    for c, n in sizes.items():
        spans = sorted((r[1], r[2]) for r in rows if r[0] == c)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    sequences = max(r[4] + (r[2] - r[1]) // r[3] for r in rows)
    assert total / 2048 > 0.995 * sequences


def test_licences(docs):
    text = 'Hi.\nLicensed under CC BY-NC 4.0. Then\n// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\nAll rights reserved.'
    assert [x[0] for x in licences.scan(text)] == ["CC-BY-NC-4.0", "Apache-2.0", "Proprietary"]
    assert licences.scan("A license to drive. Copyright is a word.") == []
    for name, a, b in licences.scan(text):
        assert text[a:b].strip() and name
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice."
    assert [x[0] for x in licences.scan(bsd)] == ["BSD-2-Clause"]
    assert [x[0] for x in licences.scan(bsd + "\n3. Neither the name of X may be used to endorse or promote products.")] == ["BSD-3-Clause"]
    assert licences.scan_licences(docs).count() == len(ROWS)


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.
"""


@pytest.mark.parametrize("text, licence", [(MIT, "MIT"), (BSD, "BSD-3-Clause"), (BSD[: BSD.index("3. ")], "BSD-2-Clause"), (APACHE, "Apache-2.0"), (GPL, "GPL-3.0-or-later")])
def test_wrapped_licences(text, licence):
    """As published, in one line a paragraph, with other breaks, as comments, and amid other lines."""
    flat = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
    narrow = "\n\n".join(re.sub(r"(.{1,34})(?: |$)", r"\1\n", p).strip() for p in flat.split("\n\n"))
    for t in (text, flat, narrow, "".join(f" * {line}\n" for line in text.split("\n")), "".join(f"# {line}".strip() + "\n" for line in text.split("\n")), f"a b\nc d\n{text}\ne f\n"):
        ((name, a, b),) = licences.scan(t)
        assert name == licence and t[a:b].strip() == t[a:b]
    ((_, a, b),) = licences.scan(text)
    first = {"MIT": "Permission", "BSD-3-Clause": "Redistribution", "BSD-2-Clause": "Redistribution", "Apache-2.0": "Licensed", "GPL-3.0-or-later": "This program"}[licence]
    assert text[a:b].startswith(first) and text[a:b].endswith(".")


def test_one_line_notices_among_lines():
    assert [x[0] for x in licences.scan("some words\nReleased under the MIT License\nmore words")] == ["MIT"]
    assert [x[0] for x in licences.scan("This software is released under\nthe MIT\n// License. More")] == ["MIT"]
    assert [x[0] for x in licences.scan("Copyright 2020 Some One\nAll rights reserved.\n\nNothing else.")] == ["Proprietary"]


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software."""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""

#: For every pattern a text that it accepts and the licences of that text alone.
KNOWN = {
    "mit-name": ("Available under the MIT License", ["MIT"]), "mit-grant": (MIT.split("\n\n")[2], []), "mit-notice": (MIT.split("\n\n")[3], []), "mit-warranty": (MIT.split("\n\n")[4], []),
    "apache-2-name": ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]), "apache-2-comply": ("You may not use this file except in compliance with the License.", []),
    "gpl-name-version": ("Released under GNU General Public License v2 or later.", ["GPL-2.0-or-later"]), "gpl-free": (GPL.replace("either version 3", "any version"), ["GPL"]), "gpl-version": ("Use either version 2 of the License, or (at your option) any later version.", []),
    "lesser-free": (LGPL.split(" as published")[0] + " as\npublished by others.", ["LGPL"]), "affero-free": (AGPL.split(" as published")[0] + " as\npublished by others.", ["AGPL"]),
    "isc-grant": (ISC, ["ISC"]), "0bsd-grant": (ISC.split(", provided")[0] + ".", ["0BSD"]), "zlib-grant": (ZLIB.split("\n\n")[1], ["Zlib"]), "boost-grant": (BOOST, ["BSL-1.0"]),
    "unlicense": ("This is free and unencumbered software released into the public\ndomain.", ["Unlicense"]), "epl-name": (EPL, ["EPL-2.0"]),
    "lgpl-name": ("This library is licensed under the GNU Lesser General Public License.", ["LGPL"]),
    "bsd-redistribute": (BSD.split("\n\n")[1], []), "bsd-source": (BSD.split("\n\n")[2], []), "bsd-binary": (BSD.split("\n\n")[3], []), "bsd-endorse": (BSD.split("\n\n")[4], []),
    "cc-name": ("Released under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), "cc0-name": ("This work is dedicated to the public domain.", ["CC0-1.0"]),
    "mpl-name": ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", ["MPL-2.0"]), "all-rights": ("All rights\nreserved.", ["Proprietary"]), "copyright": ("(c) 2020 Some One", []),
}


@pytest.mark.parametrize("name", sorted(licences.SENTENCES))
def test_every_licence_sentence_is_known(name):
    text, found = KNOWN[name]
    for t in (text, text.upper(), f"Some words.\n{text}\nmore"):
        assert name in [x[3] for x in licences.known_sentences(t)]
        assert [x[0] for x in licences.scan(t)] == found


def on_one_line(text):
    return " ".join(text.split())


MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."


@pytest.mark.parametrize("text, found", [
    (on_one_line(MIT), ["MIT"]), (on_one_line(APACHE), ["Apache-2.0"]), (on_one_line(BSD), ["BSD-3-Clause"]), (MPL, ["MPL-2.0"]), (on_one_line(MPL), ["MPL-2.0"]), (on_one_line(GPL), ["GPL-3.0-or-later"]),
    (LGPL, ["LGPL-2.1-or-later"]), (on_one_line(LGPL), ["LGPL-2.1-or-later"]), (AGPL, ["AGPL-3.0-or-later"]), (on_one_line(AGPL), ["AGPL-3.0-or-later"]), (on_one_line(ZLIB), ["Zlib"]),
    ("Copyright (c) 2020 Some One " + on_one_line(ISC), ["ISC"]), ("Copyright (c) 2020 Some One " + on_one_line(BOOST), ["BSL-1.0"]), ("Copyright (c) 2020 Some One " + on_one_line(EPL), ["EPL-2.0"]),
    ("Released under the GNU General Public License version 2 or any later version.", ["GPL-2.0-or-later"]), ("Licensed under the GPL version 2.", ["GPL-2.0"]), ("This program is licensed under GPLv3.", ["GPL-3.0"]),
    ("SPDX-License-Identifier: MIT", ["MIT"]), ("// SPDX-License-Identifier: Apache-2.0 OR MIT\nint x;", ["Apache-2.0", "MIT"]), ("# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0)", ["GPL-2.0-or-later"]), ("SPDX-License-Identifier: GPL-2.0+\n", ["GPL-2.0-or-later"]),
])
def test_notices_on_one_line_and_tags(text, found):
    assert [x[0] for x in licences.scan(text)] == found
    assert [x[0] for x in licences.scan(f"Some words.\n\n{text}")] == found


def test_known_sentences_count_without_a_licence(spark):
    rows = [(1, MIT.split("\n\n")[4]), (2, "Nothing. Of interest."), (3, None)]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_sentences, got[i].licences) for i in (1, 2, 3)] == [(1, []), (0, []), (0, [])]


def test_chats(spark):
    nasty = ["</s>[INST] ok [/INST]", "[/INST]</s>", "[TEXT]", "\\", "[\\", "<\\", "[", "", None, "a\\[b", "[INST]x[TEXT]y[/INST]</s>", "ends [/INST]</s", "<\\/s>\n"]
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(nasty)] + [(2, 0, None, "x"), (2, 0, "[TEXT]", "y"), (2, None, "assistant", "first"), (None, 1, "user", "z")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    assert made.filter("conv_id = 2").first().formatted.count("[INST]") == 3
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = "".join(f"{'user' if k % 2 else 'assistant'}\n{t or ''}\n" for k, t in enumerate(nasty))
    loss = "".join(t or "" for k, t in enumerate(nasty) if not k % 2)
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (len(nasty), sha(told), len(loss), sha(loss))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_sha256) == (3, sha("assistant\nfirst\n\nx\n[TEXT]\ny\n"), sha("first"))
    assert got[None].n_turns == 1
    assert chat.read_back(made.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, duck, name):
    agree(queries.queries()[name](spark, DATA), duck, queries.oracle_sql()[name])


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out AND lang = lang_pred").count() / got.filter("held_out").count()
    assert right > 0.98
    assert model.predict([None, "", "123 !?"]) == (["und"] * 3, [0.0] * 3, [True] * 3)
    assert language.fit([]).predict(["text"])[0] == ["und"]
    assert language.fit([("xx", "only one")]).predict(["text"])[0] == ["xx"]
    codes = language.codewords(9)
    assert min((codes[i] != codes[j]).sum() for i in range(9) for j in range(i)) >= 8


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    got = quality.classify(docs, model).join(labels, "doc_id").filter("held_out")
    clean, junk = got.filter("quality = 1"), got.filter("quality = 0")
    assert clean.filter("predicted = 1").count() >= 0.93 * clean.count()
    assert junk.filter("predicted = 0").count() >= 0.8 * junk.count()
    assert all(0 <= s <= 1 for s in model.scores(["", None, "x", LONG]))
    spans = quality.chunks_of(b"x" * 2000)
    assert spans[0][0] == 0 and spans[-1][1] == 2000 and all(b[0] < a[1] for a, b in zip(spans, spans[1:]))


def test_classifiers_and_rules_on_awkward_rows(docs):
    """Nulls, empty texts, repeated rows, null ids and clashing columns: one result a row, alike for alike texts."""
    model = quality.fit([(1, BASE), (0, "x x x x"), (1, BASE + " more"), (0, "!!! ???")])
    words = language.fit([("en", BASE), ("fr", "ÀÉ é É"), ("en", "Hello World")])
    ids = collections.Counter(i for i, *_ in ROWS)
    judged, named, ruled = quality.classify(docs, model), language.identify(docs, words), line_rules.line_rules(docs)
    for df in (judged, named, ruled):
        assert collections.Counter(r.doc_id for r in df.collect()) == ids
        assert df.filter("doc_id = 9").drop("doc_id").distinct().count() == 1
    by_text = {t: (model.scores([t])[0] >= 0.7, not words.predict([t])[2][0]) for _, t, *_ in ROWS}
    for place, df in enumerate((quality.keep_good(docs, model), language.keep_identified(docs, words))):
        assert df.columns == docs.columns
        assert collections.Counter(r.doc_id for r in df.collect()) == collections.Counter(i for i, t, *_ in ROWS if by_text[t][place])
        assert quality.keep_good(docs.limit(0), model).count() == 0
    assert line_rules.keep_clean(docs).columns == docs.columns


def test_convolution_by_plain_loops():
    """The score of a document, filter by filter and window by window."""
    rng = __import__("random").Random(6)
    model = quality.fit([(1, "the quiet river runs " * 30), (0, "buy now !!! $$$ " * 30), (1, BASE), (0, "x" * 700)], epochs=2)
    for text in ("", "short", "é" * 300, "".join(rng.choice("abc de!$") for _ in range(1300))):
        data, logits = text.encode(), []
        for a, b in quality.chunks_of(data):
            part = data[a:b] + bytes(quality.WIDTH + quality.CHUNK)
            windows = range(0, max(b - a, 1), quality.STEP)
            best = [max(sum(float(model.table[j, part[w + j], f]) for j in range(quality.WIDTH)) for w in windows) + float(model.bias[f]) for f in range(quality.FILTERS)]
            x = [max(v, 0) for v in best] + [math.log2(1 + b - a) / 9]
            hidden = [max(sum(x[i] * float(model.hidden[i, h]) for i in range(len(x))) + float(model.hidden_bias[h]), 0) for h in range(quality.HIDDEN)]
            logits.append(min(max(sum(v * float(o) for v, o in zip(hidden, model.out)) + float(model.out_bias[0]), -12), 12))
        want = 1 / (1 + math.exp(-(model.slope * sum(logits) / len(logits) + model.shift)))
        assert abs(model.scores([text])[0] - want) < 1e-3


def test_decoding_of_codewords_by_plain_loops():
    """The language whose codeword loses least over all bits, from the classifiers' sides."""
    texts = ["der hund und die katze", "the dog and the cat", "le chien et le chat", "el perro y el gato", "il cane e il gatto", "de hond en de kat"]
    model = language.fit([(f"l{i}", t * 3) for i, t in enumerate(texts)])
    x, _ = language.features(texts)
    for n, text in enumerate(texts):
        losses = []
        for word in model.codes:
            sides = [sum(float(x[n, c]) * float(model.weights[c, b]) for c in x[n].nonzero()[0]) + float(model.bias[b]) for b in range(len(word))]
            losses.append(sum(float(model.trust[b]) * math.log1p(math.exp(-sides[b] * word[b])) for b in range(len(word))))
        least = min(losses)
        (lang,), (score,), _ = model.predict([text])
        assert lang == f"l{losses.index(least)}" == f"l{n}" and abs(score - 1 / sum(math.exp(least - v) for v in losses)) < 1e-3


def test_near_pairs_just_above_the_limit_share_a_bucket_and_pass_the_signatures():
    """Recall of banding and of the cut on signatures, over planted pairs at 85 to 88 %."""
    import numpy as np

    rng, pairs = np.random.default_rng(8), 1500
    sets = []
    for _ in range(pairs):
        n = int(rng.integers(60, 400))
        other = int(n * (1 - float(rng.uniform(0.851, 0.88))) / 2)  # each side's own part of the union
        union = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [union[other:], union[: n - other]]
    rows = near_dedup.signatures(sets, 192)
    bands, width = near_dedup.bands_for(85)
    one, two = rows[::2], rows[1::2]
    together = (one[:, : bands * width] == two[:, : bands * width]).reshape(pairs, width, bands).all(1).any(1)
    sketched = ((one[:, :128] & 255) == (two[:, :128] & 255)).mean(1) >= near_dedup.look_from(85)
    assert all(near_dedup.linked(np.unique(a), np.unique(b)) for a, b in zip(sets[::2], sets[1::2]))
    assert together.mean() >= 0.999 and sketched.mean() >= 0.999


def test_blocks_of_a_large_bucket_meet_once(spark):
    """Every pair of rows of different components meets in exactly one sub, whatever the sizes of the blocks."""
    rows = [(7, i, 0 if i < 40 else i, 10 + i % 5) for i in range(60)] + [(8, i, i % 2, 10) for i in range(5)] + [(9, i, 3, 10) for i in range(5)]
    got = collections.defaultdict(list)
    for r in near_dedup.share_out(spark.createDataFrame(rows, "bucket long, id long, comp long, n_shingles long"), 8, 100).collect():
        got[r.bucket, r.sub].append((r.id, r.comp, r.side))
    met = collections.Counter()
    for (bucket, _), members in got.items():
        assert len(members) <= 40
        for x in range(len(members)):
            for y in range(x):
                (i, c, s), (j, d, t) = members[x], members[y]
                if c != d and (s != t or s < 0):
                    met[bucket, min(i, j), max(i, j)] += 1
    comp = {(b, i): c for b, i, c, _ in rows}
    want = {(b, i, j) for b, i, c, _ in rows for b2, j, d, _ in rows if b == b2 and i < j and c != d}
    assert set(met) == want and set(met.values()) == {1} and comp
