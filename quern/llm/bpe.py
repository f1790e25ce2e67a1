"""Byte pair encoding as a deterministic transducer.

A sequence of tokens is what the merge list makes of its bytes exactly when every two neighbours are: this makes
BPE a regular language over tokens, and the map from bytes to tokens a rational function with one output. Reading
bytes, a state holds every place from which a token may still be under way: its node in the trie of tokens, the
token before it, and what that path has put out beyond the part all paths share. States are made when first met.
"""

from __future__ import annotations

import gc
import json
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

END = 256  # added to a byte's symbol when it ends a word
INF = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class MergeTable:
    """Tokens, their two parts and ranks, and the trie of their symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max(*vocab.values(), *self.special.values(), 0) + 1
        self.text = [""] * size
        for t, i in (*vocab.items(), *self.special.items()):
            self.text[i] = t
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.born = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.symbols: list[tuple[int, ...] | None] = [None] * size
        for byte, letter in enumerate(byte_letters()):
            if letter in vocab:
                self.symbols[vocab[letter]] = (byte,)
            if self.suffix and letter + self.suffix in vocab:
                self.symbols[vocab[letter + self.suffix]] = (byte + END,)
        self.merged: list[tuple[int, int, int]] = []
        for r, (a, b) in enumerate(pairs):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            self.rank[u, v] = r
            self.merged.append((u, v, t))
            if self.parts[t] is None:
                self.parts[t], self.born[t], self.symbols[t] = (u, v), r, self.symbols[u] + self.symbols[v]
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t, symbols in enumerate(self.symbols):
            node = 0
            for x in symbols or ():
                nxt = self.children[node].get(x)
                if nxt is None:
                    nxt = self.children[node][x] = len(self.token)
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            if symbols:
                self.token[node] = t
        leaf: dict[int, int] = {}
        self.children = [c or leaf for c in self.children]  # most nodes are leaves
        self._fits: dict[int, bool] = {}
        self._lookahead: int | None = None

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the merges leave the cut between a and b standing.

        Walks back through time: the pieces at the cut are undone, the younger first; before each undoing they lay side
        by side, and a merge of the two that ranks earlier than the one undone would have closed the cut. Merges of one
        rank go from left to right, so a tie is won by the cut against b's own merge and lost against a's.
        """
        known = self._fits.get(a << 20 | b)
        if known is not None:
            return known
        x, y, until = a, b, INF
        while True:
            r = self.rank.get((x, y), INF)
            if r < until:
                fits = False
                break
            left, right = self.born[x], self.born[y]
            if left < 0 and right < 0:
                fits = True
                break
            if left > right:
                x, until = self.parts[x][1], left
            else:
                y, until = self.parts[y][0], right + 1
        if len(self._fits) > 100_000:
            self._fits.clear()
        self._fits[a << 20 | b] = fits
        return fits

    def lookahead(self) -> int:
        """sufficient_lookahead(), found once."""
        if self._lookahead is None:
            self._lookahead = self.sufficient_lookahead()
        return self._lookahead

    def sufficient_lookahead(self) -> int:
        """Symbols past a token's end after which no later text can change it, from the merge list alone.

        A piece is taken from its right by a merge (u, v) only if v forms beside it; that needs v's symbols, and that no
        piece on v's right edge is itself taken earlier, which asks the same of earlier merges. So the bound follows the
        merges in rank order; taken[u] keeps, by rank, the furthest any merge up to it has to look.
        """
        ranks: dict[int, list[int]] = {}
        far: dict[int, list[int]] = {}

        def need(piece: int, before: int) -> int:
            i = bisect_left(ranks.get(piece, ()), before)
            return far[piece][i - 1] if i else 0

        most = 0
        for r, (u, v, _) in enumerate(self.merged):
            reach, piece, before = 0, v, r
            while True:
                reach = max(reach, need(piece, before))
                if self.parts[piece] is None:
                    break
                piece, before = self.parts[piece][1], self.born[piece]
            reach += len(self.symbols[v])
            ranks.setdefault(u, []).append(r)
            had = far.setdefault(u, [])
            had.append(max(reach, had[-1] if had else 0))
            most = max(most, reach)
        return most


class Transducer:
    """Deterministic, made as it is needed: moves[s, x] is the next state and what reading x in state s puts out.

    With counting, outputs are numbers of tokens, else tuples of tokens. `most` states are kept; beyond it, between
    two words, the table starts anew, which changes time and not results.
    """

    def __init__(self, table: MergeTable, counting: bool, most: int = 250_000):
        self.table, self.counting, self.most = table, counting, most
        self.zero = 0 if counting else ()
        self.bound = table.lookahead()
        self.clear()

    def clear(self) -> None:
        self.outs = [self.zero]  # outputs by number
        self.out_index = {self.zero: 0}
        start = self._path(0, -1, self.zero)
        self.states = [(start,)]  # paths under way, packed into one integer each
        self.index = {(start,): 0}
        self.moves: dict[int, int] = {}  # state and symbol, packed: next state and output, packed

    def _number(self, out) -> int:
        known = self.out_index.get(out)
        if known is None:
            known = self.out_index[out] = len(self.outs)
            self.outs.append(out)
        return known

    def _path(self, node: int, before: int, rest) -> int:
        """A path under way: its node, the token before it, and its output that the paths do not share."""
        return node << 44 | (before + 1) << 24 | self._number(rest)

    def step(self, s: int, x: int) -> int:
        """Makes the move from s by x: the next state, shifted left, and the number of its output."""
        t, outs = self.table, self.outs
        alive, here = [], None
        for path in self.states[s]:
            node = t.children[path >> 44].get(x)
            if node is None:
                continue
            before, token = (path >> 24 & 0xFFFFF) - 1, t.token[node]
            if token >= 0 and here is None and (before < 0 or t.neighbours(before, token)):
                here = (0, token, outs[path & 0xFFFFFF] + (1 if self.counting else (token,)))
            if t.children[node]:
                alive.append((node, before, outs[path & 0xFFFFFF]))
        if here is None:
            raise ValueError(f"the vocabulary has no token for symbol {x}")
        alive.append(here)
        if self.counting:
            shared = min([rest for _, _, rest in alive])
            state = tuple([self._path(node, before, rest - shared) for node, before, rest in alive])
        else:
            shared = here[2]
            for _, _, rest in alive:
                shared = shared[: len(rest)]
                while shared != rest[: len(shared)]:
                    shared = shared[:-1]
            state = tuple([self._path(node, before, rest[len(shared) :]) for node, before, rest in alive])
        to = self.index.get(state)
        if to is None:
            if max([rest if self.counting else len(rest) for _, _, rest in alive]) - (shared if self.counting else len(shared)) > self.bound:
                raise RuntimeError("more is held back than the merge list allows")
            to = self.index[state] = len(self.states)
            self.states.append(state)
        made = self.moves[s << 9 | x] = to << 24 | self._number(shared)
        return made

    def pending(self, s: int):
        """What the end of the word adds in state s: the open output of the path that ends here."""
        return self.outs[self.states[s][-1] & 0xFFFFFF]

    def word(self, data: bytes):
        """All that a word's bytes put out."""
        if len(self.states) > self.most:
            self.clear()
        s, total, get, outs = 0, self.zero, self.moves.get, self.outs
        body = data[:-1] if self.table.suffix else data
        for x in body:
            move = get(s << 9 | x)
            if move is None:
                move = self.step(s, x)
            out = move & 0xFFFFFF
            if out:
                total += outs[out]
            s = move >> 24
        if self.table.suffix and data:
            x = data[-1] + END
            move = get(s << 9 | x)
            if move is None:
                move = self.step(s, x)
            total += outs[move & 0xFFFFFF]
            s = move >> 24
        return total + self.pending(s)


class Recent:
    """A bounded table. `new`, which may be read directly, takes what comes first and so what comes often; a small spare
    table takes the rest and is emptied when full. After many misses all starts anew, should the texts have changed."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.new, self.spare, self.missed = {}, {}, 0

    def find(self, key):
        got = self.new.get(key)
        return self.spare.get(key) if got is None else got

    def keep(self, key, value) -> None:
        if len(self.new) < self.most:
            self.new[key] = value
            return
        self.missed += 1
        if self.missed > 16 * self.most:
            self.clear()
        if len(self.spare) >= self.most // 4:
            self.spare = {}
        self.spare[key] = value

    def all(self, keys: list, make: Callable[[list], list]) -> list:
        """The values of distinct keys; make gives those that are not held, all at once."""
        got = list(map(self.new.get, keys))
        if None not in got:
            return got
        lacking = []
        for i, v in enumerate(got):
            if v is None:
                v = got[i] = self.spare.get(keys[i])
                if v is None:
                    lacking.append(i)
        for i, v in zip(lacking, make([keys[i] for i in lacking]), strict=True):
            got[i] = v
            self.keep(keys[i], v)
        return got


@lru_cache(maxsize=4)
def table(path: str) -> MergeTable:
    """One per worker process and file."""
    made = MergeTable(path)
    gc.collect()
    gc.freeze()  # the tables live as long as the worker; the collector need not walk them
    return made
