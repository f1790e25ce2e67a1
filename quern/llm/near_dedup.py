"""Near-duplicate detection: MinHash with banding, verified on full sets, and connected components.

1. Every text becomes the set of its distinct five-word shingles, as 64-bit hashes; texts with one set form one class.
2. Minima of many universal hash functions over a set make its signature. Bands of it are hashed into buckets.
3. Each member of a bucket is compared with the bucket's least member on full sets. Alternating stars make components
   of these verified links; a large group of near copies is one component from here on.
4. What is left are buckets that hold several components. Pairs between different ones are looked at where they first
   share a bucket: signatures mark the members that have such a pair, and only for these full sets are compared.
   Buckets beyond one block are split into blocks of bounded rows and shingles; the members of a bucket's largest
   component meet the others, not each other.
5. Components of all verified links are the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import bound_batches, map_texts, materialise, read, without
from quern.llm.components import attach, components
from quern.llm.words import GOLD, M1, PLACES, U, Words, constants, mix

#: Similarity of near-duplicates: PERCENT is the contract of op8, STAGE_PERCENT that of stages of a pipeline.
WORDS, PERCENT, STAGE_PERCENT = 5, 85, 80
#: Most minima of a signature, and the probability with which the bands may miss a pair at the limit.
MINIMA, MISS = 192, 3e-7
#: One byte of 128 minima; the cut below which pairs are not looked at lies so many deviations under the limit: 70 % for 85 %.
SKETCH, LOOK_FROM = 128, 0.70
DEVIATIONS = (PERCENT / 100 - LOOK_FROM) / math.sqrt(0.85 * 0.15)
#: Documents and shingles of a block; two blocks meet at a time. Rows that a task takes in together.
BLOCK, SHINGLES, ROWS = 256, 1 << 20, 4096

FACTORS = constants("factor", MINIMA) | U(1)
SHIFTS = constants("shift", MINIMA)


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and minima in each: the most selective that miss a pair at the limit with probability MISS at most (85 %: 32 of 6, 80 %: 38 of 5)."""
    for rows in range(MINIMA, 0, -1):
        together = (percent / 100) ** rows
        bands = 1 if together == 1 else math.ceil(math.log(MISS) / math.log1p(-together))
        if bands * rows <= MINIMA:
            return bands, rows
    raise ValueError(f"{MINIMA} minima are too few for {percent} %")


def look_from(percent: int) -> float:
    """Share of equal bytes of the sketches from which full sets are compared."""
    share = percent / 100
    return share - DEVIATIONS * math.sqrt(share * (1 - share))


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    words = Words(texts, lower=True)
    grams, first, out = words.windows(WORDS), words.first.tolist(), []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= WORDS:
            out.append(np.unique(grams[lo : hi - WORDS + 1]))
        elif hi > lo:  # fewer words: the whole sequence is the one shingle
            out.append(mix(np.sum(words.hashes[lo:hi] * PLACES[: hi - lo], keepdims=True) + U(hi - lo)))
        else:
            out.append(np.zeros(0, U))
    return out


def signatures(sets: list[np.ndarray], minima: int = MINIMA) -> np.ndarray:
    """Minima of (a * x + b) mod 2**64, upper halves, for every set that is not empty."""
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    got = np.empty((minima, len(sets)), np.uint32)
    step = np.empty_like(x)
    for k in range(minima):
        np.multiply(x, FACTORS[k], out=step)
        np.add(step, SHIFTS[k], out=step)
        got[k] = np.minimum.reduceat(step, at) >> U(32)
    return got.T


def describe(texts: list, percent: int = PERCENT) -> dict[str, list]:
    n_bands, n_rows = bands_for(percent)
    sets = shingles(texts)
    some = [i for i, s in enumerate(sets) if len(s)]
    key: list = [None] * len(texts)
    bands: list = [None] * len(texts)
    sketch: list = [None] * len(texts)
    if some:
        rows = signatures([sets[i] for i in some], max(n_bands * n_rows, SKETCH))
        band = np.zeros((len(some), n_bands), U)
        for r in range(n_rows):
            band = mix(band + GOLD + rows[:, r::n_rows][:, :n_bands].astype(U))
        band = mix(band ^ (np.arange(n_bands).astype(U) * GOLD)).view(np.int64)
        low = (rows[:, :SKETCH] & 255).astype(np.uint8)
        for n, i in enumerate(some):
            s = sets[i]
            key[i] = np.array([len(s), np.sum(mix(s ^ GOLD)), np.bitwise_xor.reduce(mix(s + M1))], U).tobytes()
            bands[i], sketch[i] = band[n], low[n].tobytes()
    return {"n_shingles": [len(s) for s in sets], "key": pa.array(key, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.binary())}


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets, as sorted arrays, are near."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class Group:
    """Rows that meet in a task, as columns: sub (rows of one value are compared), id, comp, side (rows of one side are
    not compared, -1: of no side), n_shingles, sketch, and what only some steps need: bucket, bands, text."""

    def __init__(self, table: pa.Table, percent: int):
        self.table, self.percent, self.least = table, percent, look_from(percent)
        take = lambda c: table.column(c).to_numpy()
        self.id, self.comp, self.side, self.size = take("id"), take("comp"), take("side"), take("n_shingles")
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(self.id), SKETCH)
        self.bands = None
        if "bands" in table.column_names:
            self.bands, self.bucket = np.array(table.column("bands").combine_chunks().flatten()).reshape(len(self.id), -1), take("bucket")
        sub = take("sub")
        order = np.lexsort((self.side, sub))
        cuts = np.flatnonzero(np.diff(sub[order])) + 1
        self.subs = np.split(order, cuts)

    def pairs(self, rows: np.ndarray):
        """(row, rows it may be near to) for the rows of one sub: of other components and sides, with alike sizes and
        signatures, in the first bucket that they share."""
        for n, i in enumerate(rows[:-1].tolist()):
            if self.side[i] == 1:  # sides 0 come first: those that follow are of this one
                break
            j = rows[n + 1 :]
            j = j[(self.comp[j] != self.comp[i]) & ((self.side[j] != self.side[i]) | (self.side[i] < 0))]
            j = j[100 * np.minimum(self.size[j], self.size[i]) >= self.percent * np.maximum(self.size[j], self.size[i])]
            j = j[(self.sketch[j] == self.sketch[i]).mean(1) >= self.least] if len(j) else j
            if len(j) and self.bands is not None:
                first = (self.bands[j] == self.bands[i]).argmax(1)
                j = j[self.bands[i][first] == self.bucket[i]]
            if len(j):
                yield i, j

    def marked(self) -> pa.Table:
        """Rows that have a pair."""
        hit = np.zeros(len(self.id), bool)
        for rows in self.subs:
            for i, j in self.pairs(rows):
                hit[i] = True
                hit[j] = True
        return self.table.select(["bucket", "id"]).filter(pa.array(hit))

    def links(self) -> pa.Table:
        """A spanning forest, by sub, of the verified links between components."""
        high, low = [], []
        for rows in self.subs:
            root: dict[int, int] = {}
            sets: dict[int, np.ndarray] = {}

            def find(c: int, root=root) -> int:
                while (up := root.get(c, c)) != c:
                    c = up
                return c

            def set_of(i: int, sets=sets) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingles([self.table.column("text")[i].as_py()])[0]
                return sets[i]

            for i, others in self.pairs(rows):
                for j in others.tolist():
                    a, b = find(int(self.comp[i])), find(int(self.comp[j]))
                    if a != b and linked(set_of(i), set_of(j), self.percent):
                        root[max(a, b)] = min(a, b)
                        high.append(max(a, b))
                        low.append(min(a, b))
                sets.pop(i, None)  # no later row meets this one
        return pa.table({"high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})


def share_out(rows: DataFrame, block: int, shingles: int) -> DataFrame:
    """rows (bucket, id, comp, n_shingles, ..) of buckets with several components, once for every pair of blocks that they
    are in: with sub and side. Nothing is split where a bucket fits one block."""
    per = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    size = per.groupBy("bucket").agg(F.max(F.struct("n", "w", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("comps"))
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(w / shingles)).cast("int")
    size = size.filter("comps > 1").select(
        "bucket", F.col("main.comp").alias("main"), blocks(F.col("n"), F.col("w")).alias("whole"),
        blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("others"), blocks(F.col("main.n"), F.col("main.w")).alias("mains"),
    )
    known = attach(rows, size, "bucket", "id")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("comp") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    cell = lambda kind, low, high, side: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), side.cast("int").alias("side"))
    places = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.col("own")
    among = F.transform(places("others"), lambda j: cell(0, F.least(own, j), F.greatest(own, j), F.when(own == j, -1).when(own < j, 0).otherwise(1)))
    against = F.transform(places("mains"), lambda j: cell(1, own, j, F.lit(0)))
    main = F.transform(places("others"), lambda i: cell(1, i, own, F.lit(1)))
    cells = F.when(F.col("whole") == 1, F.array(cell(2, F.lit(0), F.lit(0), F.lit(-1)))).when(F.col("comp") == F.col("main"), main).otherwise(F.concat(among, against))
    laid = known.withColumn("own", mine).withColumn("cell", F.explode(cells))
    return laid.withColumn("sub", F.xxhash64("bucket", "cell.kind", "cell.low", "cell.high")).withColumn("side", F.col("cell.side")).drop("cell", "own", "main", "whole", "others", "mains")


def gathered(rows: DataFrame, weight: float, function, schema: str, percent: int) -> DataFrame:
    """function(Group) over rows with sub; subs share a task up to about ROWS rows and SHINGLES shingles (weight of all rows)."""
    groups = max(1, math.ceil(weight))
    shared = rows.withColumn("task", F.pmod("sub", F.lit(groups)))
    return shared.groupBy("task").applyInArrow(lambda table: function(Group(table, percent)), schema)


def verified(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (high, low) between components, from rows with sub, side, comp and what Group needs of a class."""
    rows = materialise(rows, "to-verify")
    weight = rows.agg(F.count("*") / ROWS + F.sum("n_shingles") / SHINGLES).first()[0] or 0
    return materialise(gathered(rows.join(texts, ["id", "tk"]), weight, Group.links, "high long, low long", percent), "links")


def near_duplicates(docs: DataFrame, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", percent: int = STAGE_PERCENT) -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id (least id reachable) and kept (the id is that one).
    percent is the similarity from which two texts are near.

    Null and empty texts and texts without words have no shingles and no links. Rows with one id share the least
    component of their texts, so repeated rows share their result. Rows with a null id are not linked; they stay, with a null component. Other
    columns are ignored; an empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tk"), F.col(text).alias("text"))
    facts = materialise(map_texts(plain, lambda texts: describe(texts, percent), "n_shingles long, key binary, bands array<long>, sketch binary", ("id", "tk")), "shingle-facts")
    known = facts.filter("id IS NOT NULL AND key IS NOT NULL")
    best = known.groupBy("key").agg(F.min(F.struct("id", "tk", "n_shingles", "bands", "sketch")).alias("best"))
    classes = materialise(best.select("key", "best.*"), "shingle-classes")
    banded = classes.select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = materialise(attach(banded, shared, "bucket", "id").select("bucket", "id", "least"), "bucket-members")
    own = materialise(classes.drop("key").join(members.select("id").distinct(), "id", "left_semi"), "member-classes")
    texts = plain.join(own.select("id", "tk"), ["id", "tk"], "left_semi").groupBy("id", "tk").agg(F.first("text").alias("text"))
    texts = materialise(texts, "member-texts")

    # every member against the least of its buckets
    edges = materialise(members.filter("id > least").select("id", "least").distinct().join(own.select("id", "n_shingles"), "id"), "star-edges")
    load = edges.groupBy("least").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / SHINGLES)).cast("int").alias("parts"))
    rays = attach(edges.select("id", "least"), load, "least", "id").select("id", F.xxhash64("least", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("sub"), F.lit(1).alias("side"))
    hubs = load.select("least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.col("least").alias("id"), F.xxhash64("least", "part").alias("sub"), F.lit(0).alias("side"))
    star = rays.unionByName(hubs).join(own.drop("bands"), "id").withColumn("comp", F.col("id"))
    tied = components(verified(star, texts, percent))

    # pairs between components that share a bucket: signatures first, then sets
    placed = members.select("bucket", "id").join(tied, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp")).join(own.select("id", "n_shingles"), "id")
    sketched = own.drop("n_shingles")
    mixed = materialise(share_out(placed, block, SHINGLES), "mixed-buckets")
    marked = gathered(mixed.join(sketched, "id"), mixed.count() / ROWS, Group.marked, "bucket long, id long", percent)
    marked = materialise(marked.distinct(), "marked-members")
    more = verified(share_out(placed.join(marked, ["bucket", "id"]), block, SHINGLES).join(sketched, "id"), texts, percent)
    labels = tied if more.isEmpty() else components(tied.select(F.col("id").alias("high"), F.col("component").alias("low")).unionAll(more))

    whose = known.groupBy("id", "key").agg(F.lit(1).alias("one")).join(classes.select("key", F.col("id").alias("class_id")), "key")
    found = whose.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    found = found.groupBy("id").agg(F.min(F.coalesce("component", "class_id")).alias("component_id"))
    out = facts.select("id", "n_shingles").join(found, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").cast(docs.schema[doc_id].dataType).alias(doc_id), "n_shingles", component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = STAGE_PERCENT) -> DataFrame:
    """docs with one document of each component, columns as they are, whatever their names.

    Texts without words and rows with a null id all stay; of repeated rows with the id that stays, all do. An empty table stays empty.
    """
    gone = near_duplicates(docs, doc_id=doc_id, text=text, percent=percent).filter("NOT kept").select(F.col(doc_id).alias("id")).distinct()
    return without(docs, gone, doc_id)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=PERCENT)
