"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import aggregate as A
from quern.functions import scalar as S
from quern.plans.registry import query, same
from quern.sources.tables import table

same("win_ranking", """
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk,
       dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
same("win_ntile_percent", """
SELECT c_custkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""")
same("win_lead_lag", """
SELECT conv_id, turn, lag(role) OVER w AS before, lead(role, 2, 'none') OVER w AS after_two, lag(turn, 1, -1) OVER w AS last_turn
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")


@query("SELECT conv_id, turn, lead(turn, 1, turn * 10) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win_lead_default_row(spark, sf):
    """The default of LEAD is a value of the row, which Spark's own does not take."""
    w = Window.partitionBy("conv_id").orderBy(S.asc("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", A.lead_or(F.col("turn"), 1, F.col("turn") * 10, w).alias("next_turn"))


same("win_first_last_nth", """
SELECT o_orderkey, first_value(o_totalprice) OVER w AS first_price,
       last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_price,
       nth_value(o_totalprice, 3) OVER w AS third_price
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
same("win_rows_frame", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three,
       count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead,
       max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 5 PRECEDING) AS high
FROM events""")
same("win_range_frame", """
SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near_size,
       min(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS least
FROM part""")
same("win_running_agg", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running,
       count(*) OVER (PARTITION BY o_custkey) AS n, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 6) AS mean
FROM orders""")
same("win_named", """
SELECT s_suppkey, sum(s_suppkey) OVER a AS total, rank() OVER b AS place FROM supplier
WINDOW a AS (PARTITION BY s_nationkey), b AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)""")
same("win_over_group", """
SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, round(sum(sum(o_totalprice)) OVER (PARTITION BY o_orderstatus), 2) AS by_status,
       rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS place
FROM orders GROUP BY o_orderstatus, o_orderpriority""")
same("win_null_partition", """
SELECT o_orderkey, count(*) OVER (PARTITION BY nullif(o_orderstatus, 'O')) AS n FROM orders""")


@query("SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS kinds FROM events")
def win_count_distinct(spark, sf):
    """Ranks count the distinct values, so that no partition is held in one array."""
    mine = Window.partitionBy("user_id")
    ranked = table(spark, sf, "events").withColumn("place", F.when(F.col("event_type").isNotNull(), F.dense_rank().over(mine.orderBy(S.asc("event_type")))))
    kinds = F.coalesce(F.max("place").over(mine), F.lit(0)).cast("bigint")
    return ranked.select("event_id", kinds.alias("kinds"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3""")
def win_top_per_group(spark, sf):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(S.desc("o_totalprice"), S.asc("o_orderkey")))
    return table(spark, sf, "orders").withColumn("rn", rank).filter("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice")
