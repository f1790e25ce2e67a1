"""Tables with row versions: reading as of a moment, and changes that make new versions or whole new tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(versions: DataFrame, at: Column, since: str = "valid_from", until: str = "valid_to") -> DataFrame:
    """Row versions visible at a moment; a version ends where the next begins."""
    return versions.filter((F.col(since) <= at) & (F.col(until).isNull() | (at < F.col(until))))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys): with update None DO NOTHING, else DO UPDATE SET c = excluded.c. One full join on the keys.

    Rows of source that share a key come one after another: the first is inserted where the key is new, later ones update
    it or do nothing. A key with a null in it conflicts with none.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    row = F.struct(*source.columns)
    at = source.withColumn("quern_at", F.monotonically_increasing_id())
    ends = at.filter(known).groupBy(*[F.col(k).alias(f"quern_{k}") for k in keys]).agg(F.min_by(row, "quern_at").alias("first"), F.max_by(row, "quern_at").alias("last"))
    once = ends.select(*[F.col(f"{'last' if c in (update or ()) else 'first'}.{c}").alias(c) for c in source.columns])
    source = once.unionByName(source.filter(~known))
    new = source.select(*[F.col(c).alias(f"new_{c}") for c in source.columns], F.lit(True).alias("new_row"))
    same = [F.col(k) == F.col(f"new_{k}") for k in keys]
    joined = target.withColumn("old_row", F.lit(True)).join(new, same, "full")
    both = F.col("old_row").isNotNull() & F.col("new_row").isNotNull()
    take = lambda c: F.when(F.col("old_row").isNull() | (both & F.lit(c in (update or ()))), F.col(f"new_{c}")).otherwise(F.col(c))
    return joined.select(*[take(c).alias(c) for c in target.columns])


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """UPDATE: where is unknown the row stays as it is."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~F.coalesce(where, F.lit(False)))


def insert(target: DataFrame, rows: DataFrame, key: str | None = None, not_null: Sequence[str] = ()) -> DataFrame:
    """Appends rows once they hold to the constraints, all or none."""
    for c in not_null:
        if not rows.filter(F.col(c).isNull()).isEmpty():
            raise ValueError(f"null in {c}")
    if key:
        new = rows.select(key)
        if not new.groupBy(key).count().filter("count > 1").isEmpty() or not target.select(key).join(new, key, "left_semi").isEmpty():
            raise ValueError(f"{key} is not unique")
    return target.unionByName(rows)
