"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are covered by overlapping chunks. Learnt filters slide over each chunk; the strongest answer
of every filter, with the chunk's length, goes through a small hidden layer to one number. The mean over the chunks,
mapped so that even odds of the two labels lie at the threshold, is the document's score. Where words repeat few filters answer, so the pooled answers also tell how
varied a chunk is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, filter_texts, learn_split, map_texts, read, share_sample

WIDTH, STEP, FILTERS, HIDDEN = 6, 2, 32, 24
CHUNK, OVERLAP = 512, 128
#: Bounds of the sample that is learnt from: rows of a label, rows in all, chunks of a row, spread over its whole text.
EACH, MOST, CHUNKS = 800, 4000, 3
THRESHOLD = 0.7


def chunks_of(data: bytes) -> list[tuple[int, int]]:
    """From and to of the chunks; the last one ends with the document. An empty document is one empty chunk."""
    last = max(0, len(data) - CHUNK)
    starts = sorted({*range(0, last + 1, CHUNK - OVERLAP), last})
    return [(s, min(s + CHUNK, len(data))) for s in starts]


def lay_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks as rows of bytes, filled up with 0; their lengths."""
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    rows = np.frombuffer(b"".join(p.ljust(CHUNK + WIDTH, b"\0") for p in parts), np.uint8)
    return rows.reshape(len(parts), CHUNK + WIDTH), length


@dataclass
class QualityModel:
    table: np.ndarray  # offset in the window, byte, filter
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def pool(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strongest answer of each filter in each chunk, and where it was."""
        places = CHUNK // STEP
        answers = self.table[0][rows[:, 0 : CHUNK : STEP]]
        for j in range(1, WIDTH):
            answers += self.table[j][rows[:, j : CHUNK + j : STEP]]
        short = length < CHUNK
        if short.any():  # windows that begin past the end do not count; the first always does
            dead = np.arange(places)[None] * STEP >= np.maximum(length[short], 1)[:, None]
            part = answers[short]
            part[dead] = -1e9
            answers[short] = part
        where = answers.argmax(1)
        return np.take_along_axis(answers, where[:, None], 1)[:, 0] + self.bias, where

    def top(self, pooled: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.concatenate([np.maximum(pooled, 0), np.log2(1 + length)[:, None] / 9], 1).astype(np.float32)
        h = np.maximum(x @ self.hidden + self.hidden_bias, 0)
        return x, h, h @ self.out + self.out_bias[0]

    def chunk_logits(self, parts: list[bytes], block: int = 64) -> np.ndarray:
        got = []
        for i in range(0, len(parts), block):
            rows, length = lay_out(parts[i : i + block])
            got.append(self.top(self.pool(rows, length)[0], length)[2])
        return np.concatenate(got) if got else np.zeros(0, np.float32)

    def means(self, texts: list[str | None]) -> np.ndarray:
        parts, sizes = [], []
        for t in texts:
            data = (t or "").encode()
            spans = chunks_of(data)
            parts += [data[a:b] for a, b in spans]
            sizes.append(len(spans))
        if not sizes:
            return np.zeros(0)
        logits = np.clip(self.chunk_logits(parts).astype(float), -12, 12)
        return np.add.reduceat(logits, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / np.array(sizes)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.means(texts) + self.shift, -30, 30)))


def spread_chunks(data: bytes, most: int = CHUNKS) -> list[bytes]:
    """At most `most` of a document's chunks, at even distances from its beginning to its end."""
    spans = chunks_of(data)
    picked = sorted({round(k * (len(spans) - 1) / max(1, most - 1)) for k in range(most)}) if len(spans) > most else range(len(spans))
    return [data[spans[i][0] : spans[i][1]] for i in picked]


def constant(label: float | None) -> QualityModel:
    """Where there is nothing to tell apart: all as the one label, or as good."""
    f32 = np.float32
    model = QualityModel(np.zeros((WIDTH, 256, FILTERS), f32), np.zeros(FILTERS, f32), np.zeros((FILTERS + 1, HIDDEN), f32), np.zeros(HIDDEN, f32), np.zeros(HIDDEN, f32), np.zeros(1, f32))
    model.shift = -4.0 if label == 0 else 4.0
    return model


def fit(rows: list[tuple[int, str]], **more) -> QualityModel:
    """Learns from (label, text) rows, all of them at hand."""
    labels = np.array([y for y, _ in rows], float)
    if len(set(labels)) < 2:
        return constant(labels[0] if len(labels) else None)
    parts = [(y, part) for y, text in rows for part in spread_chunks(text.encode())]
    model = train_filters([y for y, _ in parts], [p for _, p in parts], **more)
    return calibrate(model, labels, np.concatenate([model.means([t]) for _, t in rows]))


def train_filters(labels: list[int], parts: list[bytes], epochs: int = 12, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> QualityModel:
    """Learns from chunks that carry their document's label; labels weigh the same together."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    model = QualityModel(
        rng.normal(0, 0.35, (WIDTH, 256, FILTERS)).astype(f32), np.zeros(FILTERS, f32),
        rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)).astype(f32), np.zeros(HIDDEN, f32), rng.normal(0, 0.3, HIDDEN).astype(f32), np.zeros(1, f32),
    )
    train, y = list(parts), np.array(labels, f32)
    for i in range(0, len(train)):  # as many again cut short, so that length alone says nothing
        size = int(np.exp(rng.uniform(np.log(16), np.log(CHUNK))))
        at = int(rng.integers(0, max(1, len(train[i]) - size)))
        train.append(train[i][at : at + size])
    y = np.concatenate([y, y])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(f32) * len(y)
    data, length = lay_out(train)
    params = [model.table, model.bias, model.hidden, model.hidden_bias, model.out, model.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(train))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            pooled, where = model.pool(data[pick], length[pick])
            x, h, logit = model.top(pooled, length[pick])
            pull = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[pick]) * weight[pick] / len(pick)).astype(f32)
            dh = np.outer(pull, model.out) * (h > 0)
            dx = (dh @ model.hidden.T)[:, :FILTERS] * (pooled > 0)
            table = np.zeros_like(model.table)
            rows_at, filters = np.arange(len(pick))[:, None], np.broadcast_to(np.arange(FILTERS), where.shape)
            for j in range(WIDTH):
                np.add.at(table[j], (data[pick][rows_at, where * STEP + j], filters), dx)
            grads = [table, dx.sum(0), x.T @ dh, dh.sum(0), h.T @ pull, pull.sum(keepdims=True)]
            step += 1
            for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return model


def calibrate(model: QualityModel, labels: np.ndarray, z: np.ndarray) -> QualityModel:
    """Sets slope and shift from the means of whole documents that were learnt from, both labels weighing the same: where
    they are equally likely the score is THRESHOLD."""
    spread = z.std() + 1e-6
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(a * z / spread + b)))
        g = (p - labels) * np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
        a, b = a - 1.0 * ((g * z / spread).sum() + 1e-3 * a), b - 1.0 * g.sum()
    model.slope, model.shift = float(a / spread), float(b + np.log(THRESHOLD / (1 - THRESHOLD)))
    return model


def learn(docs: DataFrame, labels: DataFrame, each: int = EACH, most: int = MOST) -> QualityModel:
    """From a bounded sample of the labelled rows that may be learnt from. Rows without label or text are left out.

    The driver gets up to CHUNKS chunks of each sampled row, from all over its text, and after learning the mean over all
    its chunks, however long the text is.
    """
    marked = labels.select("doc_id", "quality").filter(learn_split(F.col("doc_id")) & F.col("quality").isin(0, 1))
    counts = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}
    if not counts:
        return constant(None)
    rank = F.xxhash64("doc_id", F.lit(23))
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, 1.5 * each / n))])[F.col("quality")]
    picked = marked.filter(F.pmod(rank, F.lit(1 << 20)) < share * (1 << 20))
    place = F.row_number().over(Window.partitionBy("quality").orderBy(rank, "doc_id"))
    picked = picked.withColumn("place", place).filter(F.col("place") <= most // 2).drop("place")  # at most `most` rows, which may be broadcast
    sample = share_sample(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "quality", "doc_id", each, most)
    if sample is None:
        return constant(None)
    parts = map_texts(sample, lambda texts: {"parts": pa.array([spread_chunks(t.encode()) for t in texts], pa.list_(pa.binary()))}, "parts array<binary>", ("grp", "rank")).collect()
    parts = sorted((r["rank"], r["grp"], bytes(p)) for r in parts for p in r["parts"])
    if len({g for _, g, _ in parts}) < 2:
        return constant(parts[0][1])
    model = train_filters([g for _, g, _ in parts], [p for _, _, p in parts])
    means = map_texts(sample, lambda texts: {"z": model.means(texts).tolist()}, "z double", ("grp", "rank")).collect()
    means.sort(key=lambda r: (r["rank"], r["grp"], r["z"]))
    discard(sample)
    return calibrate(model, np.array([r["grp"] for r in means], float), np.array([r["z"] for r in means]))


def classify(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, held_out, score and predicted (1 if score >= threshold).

    Null and empty texts are scored as an empty chunk. Repeated rows and null ids pass through, other columns are
    ignored, an empty table gives an empty table.
    """

    def score(texts: list) -> dict[str, list]:
        got = model.scores(texts)
        return {"score": got.tolist(), "predicted": pa.array((got >= threshold).astype(int).tolist(), pa.int32())}

    made = map_texts(docs, score, "score double, predicted int", (doc_id,), text)
    return made.select(doc_id, (~learn_split(F.col(doc_id))).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs without rows that score below the threshold.

    Null and empty texts are scored as an empty chunk. Repeated rows and null ids fare as their text does, columns stay as
    they are, whatever their names, and an empty table stays empty.
    """
    return filter_texts(docs, lambda texts: (model.scores(texts) >= threshold).tolist(), text)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, learn(docs, read(spark, sf_dir, "labels")))
