"""Grouping, aggregates, grouping sets and distinct rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import aggregate as A
from quern.functions import scalar as S
from quern.operators.relational import distinct_on
from quern.plans.registry import query, same
from quern.sources.tables import table

same("agg_global", """
SELECT count(*) AS n, count(nullif(l_returnflag, 'N')) AS flagged, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 8) AS d, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem""")
same("agg_global_empty", "SELECT count(*) AS n, sum(l_quantity) AS q, max(l_shipdate) AS hi FROM lineitem WHERE l_quantity < 0")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10 ORDER BY 1, 2""")
def agg_group_having(spark, sf):
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    groups = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), revenue.alias("revenue"), F.count("*").alias("n"))
    return groups.filter("n > 10").orderBy(S.asc("l_returnflag"), S.asc("l_linestatus"))


same("agg_group_null", "SELECT nullif(o_orderstatus, 'O') AS status, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'O')")
same("agg_group_ordinal_alias", "SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2")
same("agg_distinct", """
SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, sum(DISTINCT o_custkey % 100) AS keys, round(avg(DISTINCT o_custkey % 50), 6) AS mean FROM orders GROUP BY o_orderstatus""")
same("agg_filter", """
SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 30) AS many, round(sum(l_extendedprice) FILTER (WHERE l_discount = 0), 2) AS full_price,
       round(sum(l_tax) / count(*), 8) AS mean_tax FROM lineitem GROUP BY l_returnflag""")
same("agg_having_hidden", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment HAVING max(c_acctbal) > 9000 AND count(*) > 5")


@query("""
SELECT c_nationkey, round(stddev_pop(c_acctbal), 4) AS dev, round(var_pop(c_acctbal), 2) AS var, round(stddev_samp(c_acctbal), 4) AS dev_samp,
       round(var_samp(c_acctbal), 2) AS var_samp FROM customer GROUP BY c_nationkey""")
def agg_stats_population(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.round(A.stddev(x), 4).alias("dev"), F.round(A.variance(x), 2).alias("var"), F.round(A.stddev_samp(x), 4).alias("dev_samp"), F.round(A.var_samp(x), 2).alias("var_samp")
    )


@query("SELECT count(*) AS n, var_samp(s_acctbal) AS v, stddev_samp(s_acctbal) AS s, var_pop(s_acctbal) AS p FROM supplier WHERE s_suppkey = 1")
def agg_stats_single(spark, sf):
    x = F.col("s_acctbal")
    return table(spark, sf, "supplier").filter("s_suppkey = 1").agg(F.count("*").alias("n"), A.var_samp(x).alias("v"), A.stddev_samp(x).alias("s"), A.variance(x).alias("p"))


@query("SELECT CAST(sum(CAST(9000000000000000000 + o_custkey AS HUGEINT)) AS DECIMAL(38,0)) AS total, avg(o_custkey) AS mean FROM orders")
def agg_exact_sum(spark, sf):
    """Sums of integers go past 64 bits."""
    return table(spark, sf, "orders").agg(A.exact_sum(F.lit(9000000000000000000) + F.col("o_custkey")).alias("total"), A.avg(F.col("o_custkey")).alias("mean"))


same("agg_median", "SELECT o_orderpriority, round(median(o_totalprice), 4) AS mid FROM orders GROUP BY o_orderpriority")


@query("""
SELECT c_nationkey, string_agg(c_name, ',' ORDER BY c_custkey) AS names, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments,
       string_agg(nullif(c_mktsegment, 'BUILDING'), ';' ORDER BY c_custkey) AS some
FROM customer GROUP BY c_nationkey""")
def agg_string_ordered(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(
        A.string_agg(F.col("c_name"), key).alias("names"), A.string_agg(F.col("c_mktsegment"), separator="|", distinct=True).alias("segments"),
        A.string_agg(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), key, separator=";").alias("some"),
    )


@query("""
SELECT s_nationkey, '[' || string_agg(CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE CAST(s_suppkey AS VARCHAR) END, ',' ORDER BY s_suppkey) || ']' AS keys FROM supplier GROUP BY s_nationkey""")
def agg_array_json(spark, sf):
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(A.array_agg(F.when(key % 3 != 0, key), key).alias("keys"))


@query("""
SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price,
       arg_min(nullif(o_orderstatus, 'O'), (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus <> 'O') AS first_closed FROM orders GROUP BY o_custkey""")
def agg_first_last_ordered(spark, sf):
    by = (F.col("o_orderdate"), F.col("o_orderkey"))
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        A.first(price, *by).alias("first_price"), A.last(price, *by).alias("last_price"), A.first(F.nullif(F.col("o_orderstatus"), F.lit("O")), *by).alias("first_closed")
    )


same("agg_rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
same("agg_grouping_sets", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
same("agg_grouping_fn", """
SELECT c_mktsegment, c_nationkey, grouping(c_mktsegment) AS gs, grouping(c_nationkey) AS gn, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey) HAVING count(*) > 3""")
same("agg_expr", "SELECT l_linestatus, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit, max(l_tax) - min(l_tax) AS spread FROM lineitem GROUP BY l_linestatus")
same("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on_query(spark, sf):
    return distinct_on(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [S.desc("o_totalprice"), S.asc("o_orderkey")])


same("agg_time_bucket", "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
same("bench_group_having", """
SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20""")
