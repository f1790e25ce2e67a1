"""Quality rules: plain limits on each document, and cross-document line frequency by host.

Lines are normalised and hashed. For every host the distinct documents that hold a line are counted; lines above the
limit are boilerplate and are removed, and documents that this depletes are rejected. Documents with the
same text count once, so copies of a document do not turn its lines into boilerplate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import map_texts, materialise, read
from quern.llm.words import Words

WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
#: A line is boilerplate in more than LINE_DOCS documents of its host, however many the host has.
LINE_DOCS = 20
#: A document is depleted when fewer than MIN_WORDS words are left, or less than this share.
LEFT_SHARE = 0.3
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def repeat_words(grams: np.ndarray, n: int) -> int:
    """Words covered by windows that occur twice or more, from the hashes of a text's windows and its number of words."""
    if len(grams) < 2:
        return 0
    _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[which] > 1)
    if not len(twice):
        return 0
    change = np.zeros(n + 1, np.int64)
    change[twice] += 1
    change[twice + WINDOW] -= 1
    return int((np.cumsum(change)[:n] > 0).sum())


def lines_of(data: bytes) -> tuple[int, list[dict[str, int]]]:
    """Lines equal to an earlier one; hash of the normalised line (lower case, single blanks), words and place of each with words."""
    seen, again, lines = set(), 0, []
    for at, line in enumerate(data.split(b"\n")):
        words = line.split()
        if not words:
            continue
        if line in seen:
            again += 1
        seen.add(line)
        h = xxhash.xxh64_intdigest(b" ".join(words).lower()) - (1 << 63)
        lines.append({"h": h, "words": len(words), "at": at})
    return again, lines


def measure(texts: list) -> dict[str, list]:
    words = Words(texts, lower=False)
    grams, first = words.windows(WINDOW), words.first
    n_words = np.diff(first)
    starts_char = (words.bytes & 0xC0) != 0x80
    dup, repeats, lines, same = [], [], [], []
    for i, t in enumerate(texts):
        data = (t or "").encode()
        again, found = lines_of(data)
        dup.append(again)
        lines.append(found)
        same.append(xxhash.xxh64_intdigest(data) - (1 << 63))
        repeats.append(repeat_words(grams[first[i] : max(first[i], first[i + 1] - WINDOW + 1)], int(n_words[i])))
    return {
        "n_words": n_words.astype(np.int64).tolist(),
        "word_chars": words.sums(starts_char & ~words.blank).tolist(),
        "n_symbols": words.sums(SYMBOLS[words.bytes]).tolist(),
        "n_dup_lines": dup,
        "n_repeat_words": repeats,
        "same": same,
        "lines": pa.array(lines, pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64()), ("at", pa.int32())]))),
    }


MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, same long, lines array<struct<h:bigint,words:bigint,at:int>>"


def host_of(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("\x00none"))


def line_rules(docs: DataFrame, line_docs: int = LINE_DOCS, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of docs: the id, the measures, base_failed, kept, removed_words and removed_lines (their places
    among the text's lines, from 0 and rising).

    Null and empty texts have no words and fail. Rows with a null host share one. Repeated rows count as one document
    for line counts and each get a result. Other columns are ignored; an empty table gives an empty table.
    """
    return judged(docs, line_docs, doc_id, text, host).withColumnRenamed("doc_id", doc_id).drop("host", "text_key")


def judged(docs: DataFrame, line_docs: int, doc_id: str, text: str, host: str) -> DataFrame:
    """line_rules with host (never null) and text_key, which with the id tell the row that a result is for."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), host_of(host).alias("host"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    facts = materialise(map_texts(plain, measure, MEASURED, ("doc_id", "host", "text_key")).withColumn("row", F.monotonically_increasing_id()), "line-facts")
    lines = facts.select("row", "host", "same", F.inline("lines")).withColumn("line", F.xxhash64("host", "h"))
    spread = lines.groupBy("line", "same").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("line_docs"))
    common = spread.filter(F.col("line_docs") > line_docs).select("line")
    removed = lines.select("row", "line", "words", "at").join(common, "line", "left_semi").groupBy("row").agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("at")).alias("removed_lines"))
    out = facts.drop("lines").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    out = out.withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < MIN_WORDS) | (left < LEFT_SHARE * F.col("n_words"))
    return out.select("doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words", "removed_lines")


def keep_clean(docs: DataFrame, line_docs: int = LINE_DOCS, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """docs that line_rules keeps, without their removed lines, other columns as they are. The texts are read a second time."""
    rules = judged(docs, line_docs, doc_id, text, host).filter("kept").select(F.col("doc_id").alias("rule_id"), F.col("host").alias("rule_host"), "text_key", "removed_lines")
    rules = rules.groupBy("rule_id", "rule_host", "text_key").agg(F.first("removed_lines").alias("rule_lines"))  # repeated rows share one
    same = F.col(doc_id).eqNullSafe(F.col("rule_id")) & (host_of(host) == F.col("rule_host")) & (F.xxhash64(text) == F.col("text_key"))
    lines = F.filter(F.split(text, "\n"), lambda _, at: ~F.array_contains("rule_lines", at))
    return docs.join(rules, same).withColumn(text, F.array_join(lines, "\n")).select(*docs.columns)


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(read(spark, sf_dir, "documents"))
