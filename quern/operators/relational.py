"""Relational operators that Spark SQL has no word for, composed from those it has."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import TABLES, table


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given. Rank filters on row_number are pushed below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("quern_rank", rank).filter("quern_rank = 1").drop("quern_rank")


def top_n(df: DataFrame, order: Sequence[Column], n: int, offset: int = 0) -> DataFrame:
    """ORDER BY, OFFSET and LIMIT as one top-n operator: each partition keeps offset + n rows."""
    cut = df.orderBy(*order)
    return (cut.offset(offset) if offset else cut).limit(n)


def numbered(df: DataFrame, key: str, tie: str, up: str, down: str, rows: int = 100_000, least: int = 64) -> DataFrame:
    """df with two row numbers: up in the order of key, null being the largest, down in its falling order; tie, its nulls last, rises in both.

    One shuffle deals the rows to the parts of parted; numbers within a part are moved by the rows of the parts before.
    df is read four times: counted, sampled, counted by part and numbered.
    """
    laid = parted(df, key, tie, rows, least)
    before = lambda *order: F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = laid.groupBy("quern_a", "quern_b").agg(F.count("*").alias("n"))
    base = sizes.select("quern_a", "quern_b", before("quern_a", "quern_b").alias("quern_up"), before(F.desc("quern_a"), "quern_b").alias("quern_down"))  # over the parts alone
    within = lambda order: F.row_number().over(Window.partitionBy("quern_a", "quern_b").orderBy(order, F.col(tie).asc_nulls_last()))
    out = laid.withColumn("quern_rise", within(F.col(key).asc_nulls_last())).withColumn("quern_fall", within(F.col(key).desc_nulls_first()))
    out = out.join(F.broadcast(base), ["quern_a", "quern_b"])
    out = out.withColumns({up: (F.col("quern_up") + F.col("quern_rise")).cast("bigint"), down: (F.col("quern_down") + F.col("quern_fall")).cast("bigint")})
    return out.drop("quern_a", "quern_b", "quern_up", "quern_down", "quern_rise", "quern_fall")


def parted(df: DataFrame, key: str, tie: str, rows: int, least: int, most: int = 4096) -> DataFrame:
    """df with quern_a and quern_b, the part of each row. Where key rises, parts follow one another by a, where it falls, by falling a; b rises in both.

    A part holds one key (or null) between two values of tie, or the keys between two such keys, so a frequent key is split too. Cuts
    lie about so many rows apart, and there are from least to most of them: places in a sorted sample of 40 rows to a cut, which decide
    the layout of the rows and none of their numbers.
    """
    k, t = F.col(key), F.col(tie)
    n = df.count()
    parts = min(most, max(least, n // rows))
    each = min(40, n // parts + 1)
    some = df.select(*dict.fromkeys([key, tie])).sample(min(1.0, each * parts / max(n, 1)), seed=1)
    at = F.row_number().over(Window.orderBy(k.asc_nulls_last(), t.asc_nulls_last()))  # over the sample
    cuts = some.withColumn("quern_at", at).filter(F.col("quern_at") % each == 0).orderBy("quern_at").collect()
    groups = [(x, [c[tie] for c in g if c[tie] is not None]) for x, g in groupby(cuts, lambda c: c[key])]
    groups += [] if groups and groups[-1][0] is None else [(None, [])]
    keys, ties, ends = [x for x, _ in groups[:-1]], [y for _, g in groups for y in g], [0, *accumulate(len(g) for _, g in groups)]
    # a: twice the keys of cuts that are below, and one more for such a key itself; b: the cuts of that key whose ties are below
    df = df.withColumn("quern_i", F.when(k.isNull(), len(keys)).otherwise(_below(keys, k, F.lit(0), F.lit(len(keys)))))
    place = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("quern_i"))
    itself = k.isNull() | F.coalesce(place(keys) == k, F.lit(False)) if keys else k.isNull()
    low, high = place(ends[:-1]), place(ends[1:])
    b = F.when(~itself, 0).when(t.isNull(), high).otherwise(_below(ties, t, low, high))
    return df.withColumns({"quern_a": 2 * F.col("quern_i") + itself.cast("int"), "quern_b": b}).drop("quern_i")


def _below(values: list, value: Column, low: Column, high: Column) -> Column:
    """low and the number of values[low:high] less than value, by halving; these are sorted, and value is not null."""
    if not values:
        return low
    sought = F.array(*map(F.lit, values))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(values).bit_length()))])
    return F.aggregate(steps, low, lambda at, step: F.when((at + step <= high) & (F.get(sought, at + step - 1) < value), at + step).otherwise(at))


def compare_any(left: DataFrame, value: str, op: str, right: DataFrame, other: str) -> DataFrame:
    """Rows for which value op ANY (right) is true: for order comparisons one bound of the right side decides."""
    return _bounded(left, value, op, right, other, {"<": F.max, "<=": F.max, ">": F.min, ">=": F.min}, every=False)


def compare_all(left: DataFrame, value: str, op: str, right: DataFrame, other: str) -> DataFrame:
    """Rows for which value op ALL (right) is true: with a null on the right it never is, with no row always."""
    return _bounded(left, value, op, right, other, {"<": F.min, "<=": F.min, ">": F.max, ">=": F.max}, every=True)


def _bounded(left: DataFrame, value: str, op: str, right: DataFrame, other: str, bound: dict, every: bool) -> DataFrame:
    if op == "=" and not every:
        return left.join(right.select(F.col(other).alias("quern_other")), F.col(value) == F.col("quern_other"), "left_semi")
    if op in ("<>", "!=") and every:
        nulls = right.agg(F.count("*").alias("quern_n"), F.count(other).alias("quern_known"))
        kept = left.join(right.select(F.col(other).alias("quern_other")), F.col(value) == F.col("quern_other"), "left_anti").join(F.broadcast(nulls))  # one row
        return kept.filter("quern_n = 0 OR (quern_known = quern_n AND " + value + " IS NOT NULL)").drop("quern_n", "quern_known")
    if op in ("=", "<>", "!="):  # = ALL and <> ANY: least and most of the right side decide
        ends = right.agg(F.min(other).alias("quern_low"), F.max(other).alias("quern_high"), F.count("*").alias("quern_n"), F.count(other).alias("quern_known"))  # one row
        same = (F.col(value) == F.col("quern_low")) & (F.col(value) == F.col("quern_high"))
        test = (F.col("quern_n") == 0) | ((F.col("quern_n") == F.col("quern_known")) & same) if every else ~same
        return left.join(F.broadcast(ends)).filter(test).drop("quern_low", "quern_high", "quern_n", "quern_known")
    one = right.agg(bound[op](other).alias("quern_bound"), F.count("*").alias("quern_n"), F.count(other).alias("quern_known"))  # one row
    test = F.expr(f"{value} {op} quern_bound")
    if every:
        test = (F.col("quern_n") == 0) | ((F.col("quern_n") == F.col("quern_known")) & test)
    return left.join(F.broadcast(one)).filter(test).drop("quern_bound", "quern_n", "quern_known")


def chain(first: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """Set operations strictly from left to right, INTERSECT binding no closer than the others."""
    out = first
    for op, df in steps:
        out = {
            "union": lambda a, b: a.union(b).distinct(),
            "union all": lambda a, b: a.unionAll(b),
            "intersect": lambda a, b: a.intersect(b),
            "intersect all": lambda a, b: a.intersectAll(b),
            "except": lambda a, b: a.subtract(b),
            "except all": lambda a, b: a.exceptAll(b),
        }[op](out, df)
    return out


def navigate(spark, sf_dir: str, root: str, paths: dict[str, str]) -> DataFrame:
    """Columns reached over declared references, such as {"region": "l_orderkey.o_custkey.c_nationkey.n_regionkey.r_name"}.

    Every distinct prefix is one LEFT JOIN, shared by all paths that begin with it; targets are keys, so no row multiplies.
    """
    df = table(spark, sf_dir, root)
    df = df.select(*[F.col(c).alias(f"_{c}") for c in df.columns])
    joined: dict[tuple[str, ...], tuple[str, str]] = {(): (root, "")}  # prefix: (table, column prefix)
    chosen = []
    for alias, path in paths.items():
        *steps, column = path.split(".")
        for i, step in enumerate(steps):
            prefix = tuple(steps[: i + 1])
            if prefix in joined:
                continue
            at, before = joined[prefix[:-1]]
            if step not in TABLES[at].references:
                raise ValueError(f"{at}.{step} is no reference")
            target, key = TABLES[at].references[step]
            mark = "_".join(prefix)
            other = table(spark, sf_dir, target)
            other = other.select(*[F.col(c).alias(f"{mark}_{c}") for c in other.columns])
            df = df.join(other, F.col(f"{before}_{step}") == F.col(f"{mark}_{key}"), "left")
            joined[prefix] = (target, mark)
        chosen.append(F.col(f"{joined[tuple(steps)][1]}_{column}").alias(alias))
    return df.select(*chosen)


def generate_series(spark, start: int, stop: int, step: int | None = None) -> DataFrame:
    """Column value; without a step it runs down where start > stop. Rows come from range, not from one array."""
    step = step if step is not None else (1 if start <= stop else -1)
    if step == 0:
        raise ValueError("a series needs a step other than 0")
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("value"))


#: Seconds of a unit; a month counts as 30 days and a year as 365.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def generate_series_time(spark, start: str, stop: str, every: int, unit: str) -> DataFrame:
    step = every * SECONDS[unit.lower().rstrip("s")] * 1_000_000
    ends = spark.sql(f"SELECT unix_micros(timestamp'{start}'), unix_micros(timestamp'{stop}')").first()
    return generate_series(spark, ends[0], ends[1], step).select(F.timestamp_micros("value").cast("timestamp_ntz").alias("value"))
