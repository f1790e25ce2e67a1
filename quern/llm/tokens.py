"""Token counts by a compiled finite-state tokenizer.

Two machines in a row. The splitter is a dense transducer over character classes that marks where words begin, with
its one or two characters of lookahead folded into states and delayed marks. The counter is the byte pair transducer
of `bpe`, whose transitions carry the number of tokens they settle. The texts of a step form one stream, cut into chunks
of equal length. A chunk is a map: from each state it may be entered in, to the state it is left in and the tokens of
the words that begin and end within it. Maps are made for all chunks at once and composed by a parallel prefix scan,
counts along with states; the words that cross from one chunk to the next are added when the entry states are known.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe
from quern.llm.common import STEP_RUNS, map_texts, package_path, read

#: The characters of the White_Space property.
SPACES = "\t\n\v\f\r \x85\xa0                　"

LETTER, STMD, R_V, EL, E, NUMBER, BLANK, SPACE, QUOTE, OTHER, CUT, UNKNOWN = range(12)
START, IN_L, IN_N, IN_O, ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE, QUOTED, QUOTED_RV, QUOTED_L, CLOSED = range(12)
HERE, BEFORE = 1, 2  # a word begins at this character; at the one before
CHUNK = 512


def classes_of(ch: str) -> int:
    kind = unicodedata.category(ch)
    if ch in SPACES:
        return SPACE
    return LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else UNKNOWN if kind == "Cn" else OTHER


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point. Code points that this Python does not know yet are settled when met."""
    got = np.full(0x110000, UNKNOWN, np.uint8)
    for c in range(0x110000):
        if 0x323B0 <= c < 0xE0000:  # planes without characters
            continue
        got[c] = classes_of(chr(c))
    got[0xD800:0xE000] = CUT  # surrogates cannot occur in text and serve as separators
    for c, letters in ((STMD, "stmd"), (R_V, "rv"), (EL, "l"), (E, "e"), (BLANK, " "), (QUOTE, "'")):
        for ch in letters:
            got[ord(ch)] = c
    return got


@lru_cache(maxsize=1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks, by state and class, of the word pattern of byte-level vocabularies."""
    letters = (LETTER, STMD, R_V, EL, E)
    to, mark = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)

    def begin(k: int) -> int:
        return IN_L if k in letters else {NUMBER: IN_N, BLANK: ONE_BLANK, SPACE: ONE_SPACE, QUOTE: QUOTED, CUT: START}.get(k, IN_O)

    for s in range(12):
        for k in range(12):
            nxt, m = begin(k), HERE
            spaces = {BLANK: MORE_BLANK, SPACE: MORE_SPACE}.get(k)
            if s == IN_L and k in letters or s == IN_N and k == NUMBER or s == IN_O and k in (QUOTE, OTHER, UNKNOWN):
                nxt, m = s, 0
            elif s in (ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE) and spaces is not None:
                nxt, m = spaces, 0
            elif s in (ONE_BLANK, MORE_BLANK) and k != CUT:  # the last blank goes with what follows it
                nxt, m = (IN_O if k == QUOTE else begin(k)), (BEFORE if s == MORE_BLANK else 0)
            elif s == MORE_SPACE and k != CUT:
                m = BEFORE | HERE
            elif s == QUOTED and k in (STMD, R_V, EL):
                nxt, m = {STMD: CLOSED, R_V: QUOTED_RV, EL: QUOTED_L}[k], 0
            elif s == QUOTED and k in (QUOTE, OTHER, UNKNOWN):
                nxt, m = IN_O, 0
            elif (s, k) in ((QUOTED_RV, E), (QUOTED_L, EL)):
                nxt, m = CLOSED, 0
            elif s in (QUOTED_RV, QUOTED_L):  # the quote stood alone; its letter begins a run
                nxt, m = (IN_L, BEFORE) if k in letters else (begin(k), BEFORE | HERE)
            to[s, k], mark[s, k] = nxt, m
    return to, mark


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Maps, one a row, from entry states to exit states and counts: first, then the other."""
    way = first[0].astype(np.intp)
    return np.take_along_axis(then[0], way, axis=1), first[1] + np.take_along_axis(then[1], way, axis=1)


def prefix_scan(exits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row i becomes the composition of rows 0 to i, in about log2(n) rounds over all rows at once."""
    exits, counts, step = exits.copy(), counts.copy(), 1
    while step < len(exits):
        exits[step:], counts[step:] = compose((exits[:-step], counts[:-step]), (exits[step:], counts[step:]))
        step *= 2
    return exits, counts


NONE = -2  # a state that no text leads to may mark the place before the stream, -1


class Marks:
    """Where words begin in chunks (rows of classes), for every state that a chunk may be entered in.

    The states soon meet: marks are kept for each state over the first columns, until all chunks have but one state left,
    and once from there on. head and tail are places in the stream where words begin: head with its row (chunk * 12 +
    entry state), tail with its chunk; both rise within a row. exits are the states that chunks are left in.
    """

    def __init__(self, kinds: np.ndarray):
        to, mark = splitter()
        flat, flat_mark = to.ravel(), mark.ravel()
        chunks, length = kinds.shape
        columns = np.ascontiguousarray(kinds.T)
        states = np.repeat(np.arange(12, dtype=np.uint8)[None], chunks, 0)
        heads, j = [], 0
        while j < length and (states != states[:, :1]).any():
            at = states * np.uint8(12) + columns[j][:, None]
            heads.append(flat_mark[at])
            states = flat[at]
            j += 1
        tails, state = np.zeros((length, chunks), np.uint8), states[:, 0]
        for k in range(j, length):
            at = state * np.uint8(12) + columns[k]
            tails[k], state = flat_mark[at], flat[at]
        self.exits = states if j == length else np.repeat(state[:, None], 12, 1)
        tails = np.ascontiguousarray(tails.T).ravel()
        self.tail, self.tail_chunk = self._begins(tails, np.repeat(np.arange(chunks), length), np.arange(chunks * length))
        heads = np.stack(heads, 2) if heads else np.zeros((chunks, 12, 0), np.uint8)
        row = np.repeat(np.arange(chunks * 12), heads.shape[2])
        place = (np.arange(chunks)[:, None, None] * length + np.zeros((1, 12, 1), np.int64) + np.arange(heads.shape[2])).ravel()
        self.head, self.head_row = self._begins(heads.ravel(), row, place)

    @staticmethod
    def _begins(marks: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and rows of all begins, from marks at places."""
        some = np.flatnonzero(marks)
        m, place, row = marks[some], place[some], row[some]
        twice = ((m & BEFORE) > 0).astype(np.int64) + ((m & HERE) > 0)
        at = np.repeat(place - ((m & BEFORE) > 0), twice)
        second = np.flatnonzero(np.repeat(twice == 2, twice))[1::2]
        at[second] += 1
        return at, np.repeat(row, twice)


def ends_of(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last value of each of n rows, NONE where there is none."""
    first, last = np.full(n, NONE, np.int64), np.full(n, NONE, np.int64)
    first[rows[::-1]] = values[::-1]
    last[rows] = values
    return first, last


class Counter:
    """Counts tokens of whole texts as the library does for a byte-level vocabulary file."""

    def __init__(self, path: str, kept_words: int = 600_000):
        self.path = path
        self.table = bpe.table(path)
        self.machine = bpe.Transducer(self.table, counting=True)
        self.kinds = class_table()
        self.seen = bpe.Recent(kept_words)
        self.special = sorted(self.table.special, key=len, reverse=True)

    def settle(self, points: np.ndarray) -> None:
        """Asks the library's own splitter for the class of code points that this Python does not know."""
        from tokenizers import Tokenizer

        split = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        for c in points.tolist():
            self.kinds[c] = next((k for k, before in ((LETTER, "a"), (NUMBER, "1")) if len(split(before + chr(c))) == 1), OTHER)

    def make(self, words: list[str]) -> list[int]:
        return [self.machine.word(w.encode()) for w in words]

    def words(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Tokens of the words that lie in data from starts to stops."""
        sizes = np.maximum(stops - starts, 0)
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        body = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
        coded = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(body)).dictionary_encode()
        known = self.seen.all(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.make)
        return np.array(known, np.int64)[coded.indices.to_numpy()] if known else np.zeros(0, np.int64)

    def counts(self, texts: list[str | None], chunk: int = CHUNK) -> np.ndarray:
        cut = "\ud800"
        extra = np.zeros(len(texts), np.int64)
        ready = []
        for i, t in enumerate(texts):
            t = t or ""
            for special in self.special:
                if special in t:
                    extra[i] += t.count(special)
                    t = t.replace(special, cut)
            ready.append(t + cut)
        if not ready:
            return extra
        # every text begins a chunk; what is left of its last one is filled with the separator, which is a word of no bytes
        sizes = np.fromiter(map(len, ready), np.int64, len(ready))
        last = np.cumsum(-(-sizes // chunk)) - 1
        points = np.full((last[-1] + 1) * chunk, ord(cut), np.uint32)
        shift = np.concatenate([[0], last[:-1] + 1]) * chunk - np.concatenate([[0], np.cumsum(sizes)[:-1]])
        stream = "".join(ready)
        points[np.repeat(shift, sizes) + np.arange(len(stream))] = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[points]
        if (kinds == UNKNOWN).any():
            self.settle(np.unique(points[kinds == UNKNOWN]))
            kinds = self.kinds[points]
        data = np.frombuffer(stream.replace(cut, "").encode(), np.uint8)
        width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        width[kinds == CUT] = 0
        byte = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=byte[1:])
        exits, counts, first, final = self.maps(kinds.reshape(-1, chunk), data, byte)
        exits, counts = prefix_scan(exits, counts)
        row = np.arange(len(exits)) * 12
        row[1:] += exits[:-1, START]
        open_at = np.concatenate([[NONE], np.maximum.accumulate(final[row])[:-1]])
        crossing = np.flatnonzero((open_at != NONE) & (first[row] != NONE))
        total = counts[:, START].copy()
        more = np.zeros(len(total), np.int64)
        more[crossing] = self.words(data, byte[open_at[crossing]], byte[first[row][crossing]])
        total += np.cumsum(more)
        return np.diff(total[last], prepend=0) + extra

    def maps(self, kinds: np.ndarray, data: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every chunk and entry state: the exit state and the count of tokens of the words that begin and end in it, and
        by row where its first and its last word begin."""
        chunks = len(kinds)
        marks = Marks(kinds)
        tail_first, tail_last = ends_of(marks.tail, marks.tail_chunk, chunks)
        head_first, head_last = ends_of(marks.head, marks.head_row, chunks * 12)
        inner = np.flatnonzero(marks.tail_chunk[1:] == marks.tail_chunk[:-1])
        stops = np.full(len(marks.head), NONE, np.int64)
        same = np.flatnonzero(marks.head_row[1:] == marks.head_row[:-1])
        stops[same] = marks.head[same + 1]
        ends = np.flatnonzero(stops == NONE)
        stops[ends] = tail_first[marks.head_row[ends] // 12]
        closed = np.flatnonzero(stops != NONE)
        n = self.words(data, byte[np.maximum(np.concatenate([marks.tail[inner], marks.head[closed]]), 0)], byte[np.concatenate([marks.tail[inner + 1], stops[closed]])])
        shared = np.bincount(marks.tail_chunk[inner], n[: len(inner)], chunks)
        own = np.bincount(marks.head_row[closed], n[len(inner) :], chunks * 12)
        counts = (own.reshape(chunks, 12) + shared[:, None]).astype(np.int64)
        first = np.where(head_first != NONE, head_first, np.repeat(tail_first, 12))
        final = np.where(np.repeat(tail_last, 12) != NONE, np.repeat(tail_last, 12), head_last)
        return marks.exits, counts, first, final


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids pass through, other columns are ignored,
    an empty table gives an empty table. tokenizer is a vocabulary file of the package of public tokenizers.
    """

    def count(texts: list) -> dict[str, list]:
        n = counter(package_path(tokenizer)).counts(texts)
        return {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n.tolist(), "over_limit": (n > limit).tolist()}

    return map_texts(docs, count, "n_bytes long, n_tokens long, over_limit boolean", (doc_id,), text, STEP_RUNS)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
