"""Packing documents into sequences by cutting-stock column generation.

A document is cut into whole sequences, a block of whole sixteenths of a sequence, and what is left. Blocks fit exactly and
what is left is rounded up to classes of a few tokens, so that small pieces can fill every gap; the histogram of classes, whose size does not depend on the corpus, goes to the driver. There a linear program over patterns
(how many pieces of each class share a sequence) is solved by column generation: a knapsack by dynamic programming,
priced with the duals, finds the next pattern. Patterns are used a whole number of times; the few pieces that rounding
leaves are placed by best fit. Back on the cluster, every piece's rank within its class decides its pattern and slot.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm.bpe import Recent
from quern.llm.common import STEP_RUNS, bound_batches, give_back, materialise, package_path, read, slices
from quern.llm.words import Runs

SEQUENCE, BLOCK, GRAIN, END_ID = 2048, 128, 4, 1
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, class int, task int, at long"


#: Rules under which runs may be cut into parts: lower case after NFC; contractions, letters, each digit, the rest.
PART_RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]


class LibraryIds:
    """Ids of runs as little-endian unsigned 32-bit bytes. The library takes many runs in one call, with a mark of its own
    id between two; a bounded table holds those that came first. Under PART_RULES the parts of runs take their place, as
    they are fewer: a word before a comma, before a full stop and with a capital is one."""

    MARK, CALL = "\0", 20_000

    def __init__(self, path: str, kept_runs: int = 300_000):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.mark = self.of(self.MARK)
        if len(self.mark) != 1:
            raise ValueError(f"{path} has no single token for the mark")
        with open(path, "rb") as f:
            rules = json.load(f)
        self.parts = [rules["normalizer"], rules["pre_tokenizer"]] == PART_RULES and all("<" in s for s in self.special)
        self.seen = Recent(kept_runs)

    def of(self, run: str) -> list[int]:
        return self.library.encode(run, add_special_tokens=False).ids

    def make(self, runs: list[str]) -> list[bytes]:
        got = [b""] * len(runs)
        plain = []
        for i, run in enumerate(runs):
            if self.MARK in run or ("<" in run and any(s in run for s in self.special)):
                got[i] = np.array(self.of(run), "<u4").tobytes()
            else:
                plain.append(i)
        for at in range(0, len(plain), self.CALL):
            some = plain[at : at + self.CALL]
            joined = f" {self.MARK} ".join([runs[i] for i in some])
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark[0]).tolist()
            if len(cuts) != len(some) - 1:
                raise ValueError("the library does not keep runs apart")
            data, start = ids.tobytes(), 0
            for i, cut in zip(some, [*cuts, len(ids)], strict=True):
                got[i] = data[4 * start : 4 * cut]
                start = cut + 1
        return got

    def texts(self, texts: list[str | None]) -> list[bytes]:
        runs = Runs(texts, self.parts)
        data, offsets = runs.spread(self.seen.all(runs.distinct, self.make))
        edge = offsets[runs.first].tolist()
        return [bytes(data[a:b]) for a, b in zip(edge, edge[1:])]


@lru_cache(maxsize=2)
def ids_of(path: str) -> LibraryIds:
    return LibraryIds(path)


def cuts(n: int, sequence: int, block: int) -> list[tuple[int, int]]:
    """From and to of the pieces of a document of n tokens."""
    marks = sorted({*range(0, n + 1, sequence), n - n % block, n})
    return list(zip(marks, marks[1:]))


def pieces(docs: DataFrame, tokenizer: str, sequence: int, block: int, grain: int, doc_id: str, text: str) -> DataFrame:
    """One row for each piece; `at` counts the pieces of a class within its task."""
    bound_batches(docs.sparkSession)
    names = [doc_id, *(c.split()[0] for c in PIECE.split(", "))]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task = ids_of(package_path(tokenizer)), TaskContext.get().partitionId()
        count = [0] * (sequence // grain + 1)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], STEP_RUNS, len(texts)):
                rows, of = [], []
                for i, data in enumerate(codec.texts(texts[a:b]), a):
                    data += end
                    n = len(data) // 4
                    for start, stop in cuts(n, sequence, block):
                        part = data[4 * start : 4 * stop]
                        k = -(-len(part) // (4 * grain))
                        rows.append((start, len(part) // 4, zlib.crc32(part), n, k, task, count[k]))
                        of.append(i)
                        count[k] += 1
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)
        give_back()

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, {PIECE}")


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, by dynamic programming."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    w, v = sizes[useful], values[useful]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(w, c, side="right")
        if k:
            got = best[c - w[:k]] + v[:k]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], took[c] = got[j], j
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[useful[took[c]]] += 1
            c -= int(w[took[c]])
    return float(best[capacity]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, most_rounds: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often the linear program uses each.

    Revised simplex. A pattern enters while the best one is worth over 1 + gap at the duals: by Farley's bound the
    program's value is then within that share of the optimum.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    for r in range(most_rounds):
        value, pattern = best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = pattern
        x -= ratio[leave] * direction
        x[leave] = ratio[leave]
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        if r % 200 == 199:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
    return basis.T.astype(np.int64).reshape(m, m), np.maximum(x, 0)


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Sizes in falling order, each into the fullest sequence that takes it."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    for size in sorted(items, reverse=True):
        free = next((f for f in range(size, capacity + 1) if room.get(f)), None)
        if free is None:
            bins.append([size])
            b, free = len(bins) - 1, capacity
        else:
            b = room[free].pop()
            bins[b].append(size)
        room.setdefault(free - size, []).append(b)
    return bins


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (class, from rank, to rank, pieces of the class in a sequence, first sequence, first slot).

    At most one row for each class of each pattern or left-over sequence, however large the corpus is.
    """
    classes = np.array(sorted(c for c, n in histogram.items() if n), np.int64)
    rows, used, sequence = [], dict.fromkeys(classes.tolist(), 0), 0

    def place(content: dict[int, int], times: int) -> None:
        nonlocal sequence
        slot = 0
        for c, each in content.items():
            rows.append((c, used[c], used[c] + each * times, each, sequence, slot))
            used[c] += each * times
            slot += each
        sequence += times

    if len(classes):
        demand = np.array([histogram[c] for c in classes.tolist()], float)
        patterns, x = solve(classes, demand, capacity)
        for pattern, times in zip(patterns, np.floor(x + 1e-7).astype(np.int64).tolist(), strict=True):
            content = {c: int(k) for c, k in zip(classes.tolist(), pattern, strict=True) if k}
            times = min([times, *((histogram[c] - used[c]) // k for c, k in content.items())])
            if times:
                place(content, times)
        left = [c for c in classes.tolist() for _ in range(histogram[c] - used[c])]
        for content in best_fit(left, capacity):
            place({c: content.count(c) for c in dict.fromkeys(content)}, 1)
    return rows


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", sequence: int = SEQUENCE, block: int = BLOCK, grain: int = GRAIN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: the id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A null or empty text is one piece that holds the end id alone. Repeated rows are packed each for itself, null ids
    pass through, other columns are ignored, an empty table gives an empty table.
    """
    spark = docs.sparkSession
    made = materialise(pieces(docs, tokenizer, sequence, block, grain, doc_id, text), "pieces")
    counts = materialise(made.groupBy("task", "class").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most sequence / grain rows
    rows = plan(histogram, sequence // grain)
    ranges = spark.createDataFrame(rows, "class int, low long, high long, each long, first long, slot0 long")
    ranked = made.join(bases, ["task", "class"]).withColumn("rank", F.col("base") + F.col("at"))
    placed = (
        ranked.join(F.broadcast(ranges), "class")
        .filter("rank >= low AND rank < high")
        .withColumn("sequence_id", F.expr("first + (rank - low) DIV each"))
        .withColumn("slot", F.expr("slot0 + (rank - low) % each"))
    )
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
