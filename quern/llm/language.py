"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier over hashed character n-grams predicts each bit. Decoding takes the
language whose codeword has the least logistic loss over all bits, each bit weighted by how well it was learnt. A
document is ambiguous when the two nearest codewords are about as near.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import GROUPS, discard, filter_texts, learn_split, map_texts, read, share_sample
from quern.llm.tokens import E as LAST_LETTER
from quern.llm.tokens import class_table

BUCKETS = 4096
#: Bounds of the sample that is learnt from: rows of a language, rows in all. Texts are taken whole.
EACH, MOST = 400, 8000
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """Rows of -1 and 1: all two-sided splits of up to five languages, else random words chosen for their distance."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        splits = [[1 if i == 0 or s >> (i - 1) & 1 else -1 for i in range(n)] for s in range(2 ** (n - 1) - 1)]
        return np.array(splits, float).T
    rng, bits = np.random.default_rng(5), int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(200)]
    return max(tries, key=lambda c: ((bits - c @ c.T) / 2 + bits * np.eye(n)).min())


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the shares of hashed n-grams of one to three characters, by text; whether the text has a letter."""
    joined = "".join((t or "").lower() + "\ud800\ud800\ud800" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = class_table()[points]
    letter = kinds <= LAST_LETTER
    edge = points == 0xD800
    c = np.where(letter, points, np.uint32(32)).astype(np.uint32)
    owner = np.cumsum(edge)
    owner = ((owner - edge) // 3).astype(np.int64)
    one = c * np.uint32(2654435761)
    two = one[:-1] + c[1:] * np.uint32(2246822519)
    three = two[:-1] + c[2:] * np.uint32(3266489917)
    cells = np.zeros(len(texts) * BUCKETS)
    for seed, grams, width in ((1, one, 1), (2, two, 2), (3, three, 3)):
        grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(2246822519 + 2 * seed)
        at = grams >> np.uint32(20)
        some = letter[: len(at)].copy()
        for k in range(1, width):
            some |= letter[k : len(at) + k]
        some &= ~edge[: len(at)]
        cells += np.bincount(owner[: len(at)][some] * BUCKETS + at[some], minlength=len(cells))
    counts = cells.reshape(len(texts), BUCKETS)
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32), total[:, 0] > 0


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    margin: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether it is ambiguous. Texts without a letter are `und`, with score 0."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        x, known = features(texts)
        side = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -side[:, None, :] * self.codes[None]) * self.trust).sum(2)
        best = loss.argmin(1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / share.sum(1)
        ordered = np.sort(loss, 1)
        close = ordered[:, 1] - ordered[:, 0] < self.margin if len(self.languages) > 1 else np.zeros(len(texts), bool)
        return (
            [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
            [float(min(s, 1.0)) if k else 0.0 for s, k in zip(score, known, strict=True)],
            [bool(c or not k) for c, k in zip(close, known, strict=True)],
        )


def fit(rows: list[tuple[str, str]], margin: float = 0.2, rounds: int = 150) -> LanguageModel:
    """Learns from (language, text) rows."""
    made = [features([t for _, t in rows[i : i + 100]]) for i in range(0, len(rows), 100)]  # piece by piece, to hold little
    x = np.concatenate([np.zeros((0, BUCKETS), np.float32), *(m[0] for m in made)])
    known = np.concatenate([np.zeros(0, bool), *(m[1] for m in made)])
    return fit_features([lang for lang, _ in rows], x, known, margin, rounds)


def fit_features(langs: list[str], x: np.ndarray, known: np.ndarray, margin: float = 0.2, rounds: int = 150) -> LanguageModel:
    """Learns from the features of texts: one logistic regression for each bit, all bits together, by Adam."""
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    place = {lang: i for i, lang in enumerate(languages)}
    y = codes[[place[lang] for lang in langs]] if langs else np.zeros((0, codes.shape[1]))
    if not known.all():
        x, y = x[known], y[known]
    y = y.astype(np.float32)
    w, b = np.zeros((BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for i in range(1, rounds + 1 if len(x) else 1):
        pull = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        for k, (p, g) in enumerate(((w, x.T @ pull + 1e-6 * w), (b, pull.sum(0)))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p -= 0.3 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
    right = ((x @ w + b) * y > 0).mean(0) if len(x) else np.ones(codes.shape[1])
    return LanguageModel(languages, codes, w, b, np.maximum(2 * right - 1, 0.05), margin)


def learn(docs: DataFrame, each: int = EACH, most: int = MOST, groups: int = GROUPS) -> LanguageModel:
    """From a bounded sample of the rows that may be learnt from; rows without a language or text are left out.

    All languages share the sample; more than `groups` of them are an error. Whole texts become features where they lie:
    the driver gets as many numbers of each row, however long its text is.
    """
    sample = share_sample(docs.select("doc_id", "lang", "text").filter(learn_split(F.col("doc_id"))), "lang", "doc_id", each, most, groups=groups)
    if sample is None:
        return fit([])

    def describe(texts: list) -> dict[str, list]:
        x, known = features(texts)
        return {"x": pa.array([row.tobytes() for row in x.astype(np.float16)], pa.binary()), "known": known.tolist()}

    rows = map_texts(sample, describe, "x binary, known boolean", ("grp", "rank")).collect()  # at most `most` rows of fixed size
    rows.sort(key=lambda r: (r["grp"], r["rank"], r["x"]))
    x = np.frombuffer(b"".join([r["x"] for r in rows]), np.float16).reshape(len(rows), BUCKETS).astype(np.float32)
    discard(sample)
    return fit_features([r["grp"] for r in rows], x, np.array([r["known"] for r in rows], bool))


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, held_out, lang_pred, score and ambiguous.

    Texts that are null, empty or have no letter: `und`, score 0, ambiguous. Where there was nothing to learn from every
    row is so. Repeated rows and null ids pass through, other columns are ignored, an empty table gives an empty table.
    """

    def predict(texts: list) -> dict[str, list]:
        return dict(zip(("lang_pred", "score", "ambiguous"), model.predict(texts), strict=True))

    made = map_texts(docs, predict, "lang_pred string, score double, ambiguous boolean", (doc_id,), text)
    return made.select(doc_id, (~learn_split(F.col(doc_id))).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs without rows that have no language or an ambiguous one; with nothing to learn from, all with a letter stay.

    Texts that are null, empty or have no letter go. Repeated rows and null ids fare as their text does, columns stay as
    they are, whatever their names, and an empty table stays empty.
    """

    def keeps(texts: list) -> list[bool]:
        if not model.languages:
            return [any(c.isalpha() for c in t or "") for t in texts]
        return [not a for a in model.predict(texts)[2]]

    return filter_texts(docs, keeps, text)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
