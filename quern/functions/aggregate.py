"""Aggregates with the engine's rules, all with partial aggregation on the map side where Spark has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(x: Column) -> Column:
    """SUM of integers never overflows: it is a decimal of 38 digits."""
    return F.sum(x.cast("decimal(38,0)"))


def avg(x: Column) -> Column:
    return F.avg(x.cast("double"))


def stddev(x: Column) -> Column:
    """STDDEV is of the population."""
    return F.stddev_pop(x)


def variance(x: Column) -> Column:
    return F.var_pop(x)


def stddev_samp(x: Column) -> Column:
    return F.when(F.count(x) > 1, F.stddev_samp(x))


def var_samp(x: Column) -> Column:
    return F.when(F.count(x) > 1, F.var_samp(x))


def first(x: Column, *by: Column) -> Column:
    """The value at the least key; nulls of x do not count."""
    return F.min_by(F.when(x.isNotNull(), x), F.when(x.isNotNull(), F.struct(*by)))


def last(x: Column, *by: Column) -> Column:
    return F.max_by(F.when(x.isNotNull(), x), F.when(x.isNotNull(), F.struct(*by)))


def string_agg(x: Column, *by: Column, separator: str = ",", distinct: bool = False) -> Column:
    """Texts in the order of the keys (of the texts themselves with distinct); null if there is none."""
    if distinct:
        parts = F.array_sort(F.collect_set(x.cast("string")))
    else:
        kept = F.collect_list(F.when(x.isNotNull(), F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)], x.cast("string").alias("v"))))
        parts = F.transform(F.sort_array(kept) if by else kept, lambda s: s["v"])
    return F.when(F.size(parts) > 0, F.array_join(parts, separator))


def array_agg(x: Column, *by: Column) -> Column:
    """A JSON array that keeps nulls; null if there was no row."""
    rows = F.collect_list(F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)], x.alias("v")))
    ordered = F.sort_array(rows) if by else rows
    return F.when(F.size(rows) > 0, F.to_json(F.transform(ordered, lambda s: s["v"])))


def lead_or(x: Column, n: int, default: Column, window) -> Column:
    """LEAD(x, n, default), default being any value of the row; LAG where n is negative. A null that is there stays null."""
    return F.when(F.lead(F.lit(True), n).over(window).isNull(), default).otherwise(F.lead(x, n).over(window))
