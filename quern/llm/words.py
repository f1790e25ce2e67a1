"""Words of many texts at once: their 64-bit hashes, with the six ASCII blanks around them, and their distinct forms,
with all white space around them."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa

U = np.uint64
GOLD, M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def constants(label: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(f"{label}{i}".encode()).digest()[:8] for i in range(n)), U)


LETTERS = constants("letter", 256)
PLACES = constants("place", 16) | U(1)
BASE = U(0x5851F42D4C957F2D)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))


def powers(base: U, n: int) -> np.ndarray:
    got = np.full(n, base, U)
    got[0] = 1
    return np.cumprod(got)


class Words:
    """hashes of all words; first[i] to first[i + 1] are those of text i. bytes and blank: of the texts, a blank before each."""

    def __init__(self, texts: list[str | None], lower: bool):
        data = [(t or "").encode() for t in texts]
        b = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
        blank = (b == 32) | ((b >= 9) & (b <= 13))
        starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        # a word's hash: its letters' numbers times powers of the base, from prefix sums modulo 2**64
        sums = np.concatenate([np.zeros(1, U), np.cumsum(LETTERS[b] * powers(BASE, len(b)))])
        self.hashes = mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(b))[starts] + (ends - starts).astype(U) * GOLD)
        self.edge = np.cumsum([1] + [len(d) + 1 for d in data])
        self.first = np.searchsorted(starts, self.edge)
        self.bytes, self.blank = b, blank

    def windows(self, width: int) -> np.ndarray:
        """Hashes of every `width` neighbouring words; those that cross from one text to the next are for the caller to leave out."""
        grams = np.zeros(len(self.hashes), U)
        n = len(self.hashes) - width + 1
        for k in range(width if n > 0 else 0):
            grams[:n] += self.hashes[k : n + k] * PLACES[k]
        return mix(grams)

    def sums(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[self.edge[1:] - 1] - total[self.edge[:-1]]


#: White space beyond ASCII in UTF-8: the characters of the White_Space property.
WIDE_SPACES = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


#: Classes of bytes: blanks, ASCII letters, other ASCII, digits, beyond ASCII, the apostrophe.
BLANK, LETTER, OTHER, DIGIT, WIDE, APOSTROPHE = range(6)
CLASSES = np.array([WIDE if c > 127 else BLANK if chr(c) in " \t\n\v\f\r" else DIGIT if chr(c).isdigit() else LETTER if chr(c).isalpha() else APOSTROPHE if chr(c) == "'" else OTHER for c in range(256)], np.uint8)


def inner(p: int, k: int) -> bool:
    """A part begins between two bytes of a run: ASCII both, as nothing composes across them, and either a digit or of two
    classes. None begins after an apostrophe, which may take letters along ('s, 're)."""
    return p in (LETTER, OTHER, DIGIT) and k not in (BLANK, WIDE) and (DIGIT in (p, k) or (p == LETTER) != (k == LETTER))


#: At 8 * class of a byte + class of the next one.
BEGINS = np.array([k != BLANK and (p == BLANK or inner(p, k)) for p in range(8) for k in range(8)])
ENDS = np.array([p != BLANK and (k == BLANK or inner(p, k)) for p in range(8) for k in range(8)])


class Runs:
    """Runs without white space: distinct (each once), which (of them stands at each place), and first[i] to first[i + 1]
    are the places of text i. Only the distinct ones become Python strings.

    With parts, for tokenizers that lower-case and take letters, each digit and the rest apart, a run is cut where such
    begin, and A-Z are lower-cased; not beside characters beyond ASCII, which may compose, nor in a run with <, where a
    special token may stand."""

    def __init__(self, texts: list[str | None], parts: bool = False):
        data = [(t or "").encode() for t in texts]
        data = [d if d.isascii() else WIDE_SPACES.sub(b" ", d) for d in data]
        b = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
        edge = np.cumsum([1] + [len(d) + 1 for d in data])
        if parts:
            b, blank, starts, ends = self.cut(b)
        else:
            blank = (b == 32) | ((b >= 9) & (b <= 13))
            starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
            ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        self.first = np.searchsorted(starts, edge)
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(b[~blank])).dictionary_encode()
        self.distinct, self.which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices

    @staticmethod
    def cut(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lower-cased bytes, where they are blank, and where parts begin and end."""
        kind = CLASSES[b]
        blank = kind == BLANK
        upper = (b >= 65) & (b <= 90)
        upper[:-1] &= b[1:] < 128
        if len(marks := np.flatnonzero(b == ord("<"))):
            gaps = np.flatnonzero(blank)
            after = np.unique(np.searchsorted(gaps, marks))
            whole = np.zeros(len(b), np.int8)
            whole[gaps[after - 1] + 1] = 1
            whole[gaps[after]] -= 1
            whole = np.cumsum(whole, dtype=np.int8).astype(bool)
            upper &= ~whole
            kind = np.where(whole, np.uint8(WIDE), kind)
        pairs = (kind[:-1] << 3) | kind[1:]
        return b + (upper.view(np.uint8) << 5), blank, np.flatnonzero(BEGINS[pairs]) + 1, np.flatnonzero(ENDS[pairs]) + 1

    def spread(self, values: list[bytes]) -> tuple[memoryview, np.ndarray]:
        """The values of all runs one after another, from one value for each distinct run; where each begins, and the end."""
        laid = pa.array(values, pa.large_binary()).take(self.which)
        return memoryview(laid.buffers()[2] or b""), np.frombuffer(laid.buffers()[1], np.int64)[: len(laid) + 1] if len(laid) else np.zeros(1, np.int64)
