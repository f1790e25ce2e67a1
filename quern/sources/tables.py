"""Tables, their keys and references. Every integer column is 64 bits wide, as the type system has one INTEGER."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Table:
    name: str
    key: str | None = None
    references: dict[str, tuple[str, str]] = field(default_factory=dict)  # column: (table, its key)


TABLES = {
    t.name: t
    for t in (
        Table("region", "r_regionkey"),
        Table("nation", "n_nationkey", {"n_regionkey": ("region", "r_regionkey")}),
        Table("customer", "c_custkey", {"c_nationkey": ("nation", "n_nationkey")}),
        Table("supplier", "s_suppkey", {"s_nationkey": ("nation", "n_nationkey")}),
        Table("part", "p_partkey"),
        Table("orders", "o_orderkey", {"o_custkey": ("customer", "c_custkey")}),
        Table("lineitem", None, {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
        Table("events", "event_id"),
        Table("documents", "doc_id"),
        Table("labels", "doc_id", {"doc_id": ("documents", "doc_id")}),
        Table("embeddings", "vec_id"),
        Table("pages", "page_id"),
        Table("benchmark", "item_id"),
        Table("conversations"),
    )
}


def widen(df: DataFrame) -> DataFrame:
    """Narrow integers become bigint. A plain cast in the projection, so scans stay pruned."""
    return df.select(*[F.col(n).cast("bigint").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return widen(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the named tables (all, if none is named)."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
