"""Connected components by alternating large-star and small-star, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, materialise

#: Parts into which the rows of one key are spread where they meet what is known of the key.
SALTS = 16


def attach(rows: DataFrame, facts: DataFrame, key: str, spread: str) -> DataFrame:
    """rows with the facts of their key, one row a key. Each fact goes to SALTS places and a key's rows are spread over
    these by another of their columns, so that no hot key meets in one task. Spread facts are not broadcast: Spark would
    judge them by their size before."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread, F.lit(29)), F.lit(SALTS)).cast("int"))
    everywhere = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(everywhere.hint("merge"), [key, "salt"]).drop("salt")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (high, low). Minima come from an aggregation and go back by a salted join."""
    if large:  # every neighbour above u is tied to the least of u and its neighbours
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionAll(edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        made = attach(both.filter("v > u"), least, "u", "v").select(F.col("v").alias("high"), F.col("m").alias("low"))
    else:  # every neighbour below u, and u, is tied to the least of them
        least = edges.groupBy("high").agg(F.min("low").alias("m"))
        below = attach(edges, least, "high", "low").filter("low > m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        made = below.unionAll(least.select("high", F.col("m").alias("low")))
    return made.distinct()


def state(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that is not the least of its component, from edges (high, low) with high > low.

    Rounds go on until the edges stay the same: they are then stars around the least node of each component.
    """
    edges = materialise(edges.distinct(), "edges")
    now = state(edges)
    while now[0]:
        made = materialise(star(star(edges, large=True), large=False), "edges")
        before, now = now, state(made)
        discard(edges)
        edges = made
        if before == now:
            break
    return edges.select(F.col("high").alias("id"), F.col("low").alias("component"))
