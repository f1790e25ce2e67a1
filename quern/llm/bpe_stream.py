"""Encoding and decoding by streaming transducers with bounded lookahead.

The encoder reads a text piece by piece. Runs without white space that a piece completes go through the byte pair
transducer from its start state to its end; such a path is one move, kept by the run's text, so a run that comes again
costs one look-up. A run that stays open longer than `hold` characters goes through symbol by symbol: words are cut by
a small machine with one character of lookahead, and tokens are put out as soon as every path still open agrees on
them. From the merge list follows how many symbols that can take (`MergeTable.sufficient_lookahead`); the transducer
checks each of its states against it, so what is held back never grows with the text. The decoder turns tokens back
into text through an incremental UTF-8 machine that holds at most three bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe
from quern.llm.common import STEP_RUNS, map_texts, package_path, read
from quern.llm.tokens import SPACES
from quern.llm.words import Runs

#: The endings that the word pattern cuts off, without their apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE = re.compile(f"[{SPACES}]")
#: Characters that the encoder reads at a time, and those of an open run from which it goes through symbol by symbol.
PIECE, HOLD = 1 << 16, 1 << 12


@lru_cache(maxsize=2)
def library_of(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def kind(ch: str) -> str:
    k = unicodedata.category(ch)[0]
    return k if k in "LN" else "O"


class WordCodec:
    """Encodes as the library does for a vocabulary of lower-case words with an end mark, white space dropped."""

    def __init__(self, path: str, kept_words: int = 80_000):
        self.path = path
        self.table = bpe.table(path)
        self.machine = bpe.Transducer(self.table, counting=False)
        self.words = bpe.Recent(kept_words)
        self.special = sorted(self.table.special.items(), key=lambda x: -len(x[0]))

    def cut(self, run: str) -> list[str]:
        """Words of a run without white space, in lower case."""
        if not run.isascii():
            run = unicodedata.normalize("NFC", run)
        low = run.lower() if "Σ" not in run else "".join(c.lower() for c in run)
        if low.isalpha():  # what nearly all runs are: letters, and perhaps one mark
            return [low]
        if low[-1] in ".,!?;:" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        if any(unicodedata.category(c) == "Cn" for c in run):  # newer than this Python: the library's own tables decide
            low, kinds = self._ask(run)
        else:
            kinds = [kind(c) for c in low]
        words, at = [], 0
        while at < len(low):
            end = next((at + 1 + len(e) for e in ENDINGS if low.startswith(e, at + 1)), 0) if low[at] == "'" else 0
            if not end:
                end, k = at + 1, kinds[at]
                while end < len(low) and k != "N" and kinds[end] == k:
                    end += 1
            words.append(low[at:end])
            at = end
        return words

    def _ask(self, run: str) -> tuple[str, list[str]]:
        library = library_of(self.path)
        run = library.normalizer.normalize_str(run)
        pairs = library.pre_tokenizer.pre_tokenize_str
        return run, ["N" if len(pairs(c + c)) == 2 else "L" if len(pairs("a" + c)) == 1 else "O" for c in run]

    def lower(self, ch: str) -> str:
        return ch.lower() if unicodedata.category(ch) != "Cn" else self._ask(ch)[0]

    def kind(self, ch: str) -> str:
        k = unicodedata.category(ch)
        return self._ask(ch)[1][0] if k == "Cn" else k[0] if k[0] in "LN" else "O"

    def run(self, run: str) -> tuple[int, ...]:
        """The ids of a run without white space, special strings in it included."""
        out, known = (), self.words
        for part in self.segments(run):
            if isinstance(part, int):
                out += (part,)
                continue
            for word in self.cut(part) if part else ():
                got = known.find(word)
                if got is None:
                    got = self.machine.word(word.encode())
                    known.keep(word, got)
                out += got
        return out

    def segments(self, text: str) -> Iterator[str | int]:
        """The text between special strings, and their ids."""
        for special, i in self.special:
            if special in text:
                first, *others = text.split(special)
                yield from self.segments(first)
                for part in others:
                    yield i
                    yield from self.segments(part)
                return
        yield text

    def encode(self, text: str | None) -> list[int]:
        encoder = StreamingEncoder(self)
        return encoder.feed(text or "") + encoder.finish()


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that NFC may compose with what stands before them, though they need not be combining."""
    pairs = [d for c in range(0x30000) if (d := unicodedata.decomposition(chr(c))) and "<" not in d and " " in d]
    return frozenset({chr(int(d.split()[1], 16)) for d in pairs} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


class SymbolEncoder:
    """feed() takes any pieces of one text without special strings and yields ids once stable; finish() yields the rest.

    Held between calls: the state, one byte (a word's last byte has its own symbol), the run of combining characters
    that NFC may still change, and at most three characters of lookahead.
    """

    def __init__(self, codec: WordCodec):
        self.codec, self.table, self.machine = codec, codec.table, codec.machine
        self.state, self.byte, self.kind, self.text = 0, None, None, ""
        self.held_most = 0

    def _symbol(self, x: int) -> tuple[int, ...]:
        key = self.state << 9 | x
        move = self.machine.moves.get(key)
        if move is None:
            move = self.machine.step(self.state, x)
        self.state = move >> 24
        held = max(len(self.machine.outs[p & 0xFFFFFF]) for p in self.machine.states[self.state])
        self.held_most = max(self.held_most, held)
        return self.machine.outs[move & 0xFFFFFF]

    def _end(self) -> list[int]:
        if self.byte is None:
            return []
        out = [*self._symbol(self.byte + (bpe.END if self.table.suffix else 0)), *self.machine.pending(self.state)]
        self.state, self.byte, self.kind = 0, None, None
        return out

    def _char(self, ch: str, k: str) -> list[int]:
        out = []
        if self.kind != k or k == "N":
            out += self._end()
        self.kind = k
        for b in ch.encode():
            if self.byte is not None:
                out += self._symbol(self.byte)
            self.byte = b
        return out

    def feed(self, piece: str, last: bool = False) -> list[int]:
        text = self.text + piece
        stop = len(text)
        if not last:  # the last starter may still compose with what follows
            while stop and (stop == len(text) or unicodedata.combining(text[stop]) or text[stop] in joining()):
                stop -= 1
        ready, self.text = unicodedata.normalize("NFC", text[:stop]), text[stop:]
        ready = "".join([self.codec.lower(c) for c in ready])
        out, i = [], 0
        while i < len(ready):
            ch = ready[i]
            if ch == "'" and self.kind != "O":
                if not last and i + 3 > len(ready):  # the ending may still be cut off by the piece
                    self.text = ready[i:] + self.text
                    break
                end = next((e for e in ENDINGS if ready.startswith(e, i + 1)), None)
                if end:
                    out += self._end()
                    for c in "'" + end:
                        out += self._char(c, "ending")
                    out += self._end()
                    i += 1 + len(end)
                    continue
            out += self._end() if ch in SPACES else self._char(ch, self.codec.kind(ch))
            i += 1
        if last:
            out += self._end()
        return out

    def finish(self) -> list[int]:
        return self.feed("", last=True)


class LongRun:
    """A run too long to be held: symbol by symbol, special strings in it included, of which it holds at most a beginning."""

    def __init__(self, codec: WordCodec):
        self.codec, self.encoder, self.text = codec, SymbolEncoder(codec), ""
        self.most = max([len(t) for t, _ in codec.special], default=1) - 1

    def feed(self, piece: str, last: bool = False) -> list[int]:
        text, out = self.text + piece, []
        while found := min(((text.find(t), -len(t), t, i) for t, i in self.codec.special if t in text), default=None):
            at, _, special, number = found
            out += [*self.encoder.feed(text[:at], last=True), number]
            self.encoder = SymbolEncoder(self.codec)
            text = text[at + len(special) :]
        keep = 0 if last else min(self.most, len(text))
        self.text = text[len(text) - keep :]
        return out + self.encoder.feed(text[: len(text) - keep], last)


class StreamingEncoder:
    """feed() takes any pieces of one text and yields ids once stable; finish() yields the rest.

    Held between calls: an open run of at most hold characters and one piece, or the state of a longer one.
    """

    def __init__(self, codec: WordCodec, hold: int = HOLD):
        self.codec, self.hold = codec, hold
        self.open, self.long = "", None

    def split(self, piece: str, last: bool = False) -> tuple[list[int], str]:
        """The ids that a long run puts out, and after them the text of the runs that are complete."""
        out: list[int] = []
        if self.long is None and len(self.open) > self.hold:
            self.long, piece, self.open = LongRun(self.codec), self.open + piece, ""
        if self.long is not None:
            end = SPACE.search(piece)
            out = self.long.feed(piece[: end.start()] if end else piece, last or end is not None)
            if not end:
                return out, ""
            self.long, piece = None, piece[end.start() :]
        text, stop = self.open + piece, len(self.open) + len(piece)
        while not last and stop and text[stop - 1] not in SPACES:
            stop -= 1
        self.open = text[stop:]
        return out, text[:stop]

    def feed(self, piece: str, last: bool = False) -> list[int]:
        out, ready = self.split(piece, last)
        for run in SPACE.split(ready):
            out += self.codec.run(run)
        return out

    def finish(self) -> list[int]:
        return self.feed("", last=True)


def stream(codec: WordCodec, texts: list[str | None], piece: int = PIECE, hold: int = HOLD) -> Iterator[tuple[list[int], list[list[int]], Runs]]:
    """All texts side by side, a piece of each in every round: numbers of the texts still under way, for each of them the
    ids that come first, and the complete runs that follow these."""
    under_way = [(i, t, StreamingEncoder(codec, hold)) for i, t in enumerate(texts) if t]
    at = 0
    while under_way:
        parts = [e.split(t[at : at + piece], last=at + piece >= len(t)) for _, t, e in under_way]
        yield [i for i, _, _ in under_way], [ids for ids, _ in parts], Runs([ready for _, ready in parts])
        at += piece
        under_way = [w for w in under_way if at < len(w[1])]


class StreamingDecoder:
    """Ids to text, piece by piece. With plain, words end in a blank and bytes become text through the UTF-8 machine;
    without, as the library does for a file that names no decoder: the tokens' letters, with a blank between tokens."""

    def __init__(self, table: bpe.MergeTable, plain: bool = False):
        self.table, self.plain, self.first = table, plain, True
        self.letters = [] if plain else [b" " + t.encode() for t in table.text]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        if self.plain:
            pieces = [self._plain(i) for i in ids]
        else:
            pieces = [self.letters[i] for i in ids]
            if self.first and pieces:
                pieces[0], self.first = pieces[0][1:], False
        return self.machine.decode(b"".join(pieces))

    def _plain(self, i: int) -> bytes:
        symbols = self.table.symbols[i]
        return self.table.text[i].encode() if symbols is None else b"".join([bytes([x & 255]) + b" " * (x >= bpe.END) for x in symbols])

    def finish(self) -> str:
        """What an unfinished character leaves; the machine is as new afterwards."""
        rest = self.machine.decode(b"", True)
        self.machine.reset()
        return rest


class DigestCodec(WordCodec):
    """Keeps for each run the number of ids, their decimal digits and their decoded text, a blank before each."""

    def __init__(self, path: str, kept_runs: int = 500_000):
        super().__init__(path)
        self.seen = bpe.Recent(kept_runs)
        self.decoder = StreamingDecoder(self.table)
        self.decoder.first = False
        self.digits = [f" {i}" for i in range(len(self.table.text))]

    def told(self, ids) -> tuple[int, bytes, bytes]:
        return len(ids), "".join([self.digits[i] for i in ids]).encode(), (self.decoder.feed(ids) + self.decoder.finish()).encode()

    def make(self, runs: list[str]) -> list[tuple[int, bytes, bytes]]:
        return [self.told(self.run(r)) for r in runs]

    def digests(self, texts: list[str | None], piece: int = PIECE, hold: int = HOLD) -> tuple[list[int], list[str], list[str]]:
        """Of each text: number of ids, digest of their digits, digest of the decoded text; made as pieces become stable."""
        counts = np.zeros(len(texts), np.int64)
        hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
        for numbers, first, runs in stream(self, texts, piece, hold):
            known = self.seen.all(runs.distinct, self.make)
            n = np.concatenate([[0], np.cumsum(np.array([k[0] for k in known], np.int64)[runs.which.to_numpy()] if known else [])]).astype(np.int64)
            laid = [runs.spread([k[j] for k in known]) for j in (1, 2)]
            edges = [offsets[runs.first].tolist() for _, offsets in laid]
            for place, (i, ids) in enumerate(zip(numbers, first, strict=True)):
                before = self.told(ids) if ids else (0, b"", b"")
                for j, h in enumerate(hashes[i]):
                    parts = [before[j + 1], laid[j][0][edges[j][place] : edges[j][place + 1]]]
                    if not counts[i]:  # nothing stands before the first
                        parts[0 if ids else 1] = parts[0 if ids else 1][1:]
                    for part in parts:
                        h.update(part)
                counts[i] += before[0] + n[runs.first[place + 1]] - n[runs.first[place]]
        return counts.tolist(), [a.hexdigest() for a, _ in hashes], [b.hexdigest() for _, b in hashes]


@lru_cache(maxsize=2)
def digests(path: str) -> DigestCodec:
    return DigestCodec(path)


@lru_cache(maxsize=2)
def codec_of(path: str) -> WordCodec:
    return WordCodec(path)


def encode_texts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ids array<int>. Null and empty texts give an empty array; repeated rows and null ids pass through."""

    def encode(texts: list) -> dict[str, list]:
        made = codec_of(package_path(tokenizer))
        return {"ids": pa.array([made.encode(t) for t in texts], pa.list_(pa.int32()))}

    return map_texts(docs, encode, "ids array<int>", (doc_id,), text)


def roundtrip_digests(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256 (decimal ids joined by a blank) and decoded_sha256 (the decoded text).

    Null and empty texts have no tokens, and the digests of the empty string. Repeated rows and null ids pass through,
    other columns are ignored, an empty table gives an empty table.
    """

    def digest(texts: list) -> dict[str, list]:
        return dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), digests(package_path(tokenizer)).digests(texts), strict=True))

    return map_texts(docs, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", (doc_id,), text, STEP_RUNS)


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip_digests(read(spark, sf_dir, "documents"))
