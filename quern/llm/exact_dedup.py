"""Exact deduplication with a split for heavy hitters, in DataFrame operations alone.

A Misra-Gries summary (freqItems) over the digests names every digest that may hold more than a share of the rows; the
summary never has more than 1 / share entries. An exact count verifies them. The verified winners are broadcast, so the
rows of heavy groups are settled where they lie; all others meet through an ordinary aggregation by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import free_name, lower_ascii, materialise, read, text_or_empty

#: Share of the rows from which a digest counts as heavy; the summary and the broadcast have at most 1 / SHARE rows.
SHARE = 0.001


def decisions(docs: DataFrame, share: float = SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept and text_sha256.

    Null text counts as empty. Of equal texts the row with the largest id stays, a null id being the least; of repeated
    rows with that id exactly one stays. Other columns are ignored; an empty table gives an empty table.
    """
    digest = F.sha2(lower_ascii(text_or_empty(text)).cast("binary"), 256)
    slim = materialise(docs.select(F.col(doc_id).alias("doc_id"), digest.alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")
    best = [F.max(F.struct("doc_id", (-F.col("row")).alias("minus_row"))).alias("best"), F.count("*").alias("group_size")]
    total = slim.count()
    frequent = slim.stat.freqItems(["text_sha256"], share).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    verified = slim.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256").agg(*best).filter(F.col("group_size") >= share * total)
    winners = materialise(verified, "heavy-digests")  # at most 1 / share rows
    tagged = slim.join(F.broadcast(winners), "text_sha256", "left")
    rest = tagged.filter(F.col("best").isNull()).drop("best", "group_size")
    settled = tagged.filter(F.col("best").isNotNull()).unionByName(rest.join(rest.groupBy("text_sha256").agg(*best), "text_sha256"))
    return settled.select(F.col("doc_id").alias(doc_id), F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.minus_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, share: float = SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact deduplication drops; columns stay as they are, whatever their names.

    The rows that go are written down by id (with the digest too, where ids repeat), and docs meets that small table: Spark
    broadcasts it while it is under its threshold, and shuffles beyond.
    """
    made = materialise(decisions(docs, share, doc_id, text), "decisions")
    same = F.col(doc_id).eqNullSafe(F.col("keep_id"))
    gone = materialise(made.filter(~F.col("kept") & ~same).select(F.col(doc_id).alias("id"), "text_sha256"), "copies")
    name = free_name(docs)
    if made.groupBy(doc_id).count().filter("count > 1").isEmpty():  # ids tell rows apart, as they should
        other = gone.select(F.col("id").alias(name))
        return docs.join(other, docs[doc_id].eqNullSafe(other[name]), "left_anti")
    other = gone.distinct().toDF(name, name + "_sha")
    digest = F.sha2(lower_ascii(F.coalesce(docs[text], F.lit(""))).cast("binary"), 256)
    found = docs.join(other, docs[doc_id].eqNullSafe(other[name]) & (digest == other[name + "_sha"]), "left_anti")
    return found.withColumn(name, F.sha2(lower_ascii(text_or_empty(text)).cast("binary"), 256)).dropDuplicates([doc_id, name]).drop(name)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(read(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
