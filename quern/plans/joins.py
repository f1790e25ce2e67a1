"""Joins, subqueries that are joins, and navigation over references."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.relational import compare_all, compare_any, navigate
from quern.plans.registry import query, same
from quern.sources.tables import table

same("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
same("join_left", """
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000""")
same("join_right", """
SELECT o_orderkey, c_custkey, c_name FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'""")
same("join_full", """
SELECT a.n_nationkey AS left_key, b.s_suppkey AS right_key FROM (SELECT * FROM nation WHERE n_nationkey < 15) a
FULL JOIN (SELECT * FROM supplier WHERE s_nationkey >= 10) b ON a.n_nationkey = b.s_nationkey""")
same("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same("join_comma", "SELECT r_name, count(*) AS n FROM region, nation WHERE r_regionkey = n_regionkey GROUP BY r_name")
same("join_using", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
same("join_natural", "SELECT doc_id, lang, quality, toxic FROM (SELECT doc_id, lang FROM documents) d NATURAL JOIN labels")
same("join_natural_left", "SELECT doc_id, lang, quality FROM (SELECT doc_id, lang FROM documents) d NATURAL LEFT JOIN labels")
same("join_null_keys", """
SELECT a.o_orderkey AS left_key, b.c_custkey AS right_key FROM (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 3 THEN o_custkey END AS k FROM orders) a
LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 5 THEN c_custkey END AS k FROM customer) b ON a.k = b.k""")
same("join_theta_range", """
SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b
ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal AND b.s_acctbal - a.s_acctbal < 1500""")
same("join_self", """
SELECT a.c_custkey AS one, b.c_custkey AS two FROM customer a JOIN customer b
ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) < 50""")
same("join_multiway", """
SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
same("join_or_null_residual", """
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND (o_totalprice > 450000 OR nullif(o_orderstatus, 'F') IS NULL AND o_totalprice < 5000)""")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def join_semi(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 350000")
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


same("count_semi", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
same("count_anti", "SELECT count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
same("sub_scalar", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)")
same("sub_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
same("sub_not_in_null", """
SELECT count(*) AS none FROM customer WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)""")
same("sub_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
same("sub_exists", """
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.1)""")
same("sub_not_exists", """
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)""")
same("sub_correlated", """
SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer""")
same("sub_correlated_having", """
SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey
HAVING sum(o_totalprice) > (SELECT avg(o_totalprice) * 15 FROM orders)""")
same("sub_row_in", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, p_size FROM part WHERE p_size < 20)""")
same("derived_table", """
SELECT kind, count(*) AS n, round(avg(spent), 2) AS mean FROM (
  SELECT o_custkey, sum(o_totalprice) AS spent, CASE WHEN count(*) > 12 THEN 'many' ELSE 'few' END AS kind FROM orders GROUP BY o_custkey) t GROUP BY kind""")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def sub_any(spark, sf):
    right = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 0")
    return compare_any(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", ">", right, "c_acctbal").select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 12)")
def sub_all(spark, sf):
    right = table(spark, sf, "supplier").filter("s_nationkey < 12")
    return compare_all(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ">=", right, "s_acctbal").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey <> ALL (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 10)")
def sub_not_equal_all(spark, sf):
    right = table(spark, sf, "supplier").filter("s_suppkey <= 10")
    return compare_all(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "<>", right, "s_nationkey").select("c_custkey")


@query("SELECT o_orderkey, c_name AS customer, o_totalprice AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def nav_one_step(spark, sf):
    return navigate(spark, sf, "orders", {"o_orderkey": "o_orderkey", "customer": "o_custkey.c_name", "price": "o_totalprice"})


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS brand, c_name AS customer, n_name AS nation, r_name AS region FROM lineitem
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def nav_transitive(spark, sf):
    path = "l_orderkey.o_custkey"
    return navigate(spark, sf, "lineitem", {
        "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "brand": "l_partkey.p_brand",
        "customer": f"{path}.c_name", "nation": f"{path}.c_nationkey.n_name", "region": f"{path}.c_nationkey.n_regionkey.r_name",
    })


@query("""
SELECT n_name AS nation, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 10""")
def nav_group(spark, sf):
    df = navigate(spark, sf, "orders", {"nation": "o_custkey.c_nationkey.n_name", "price": "o_totalprice"})
    return df.groupBy("nation").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total")).filter("n > 10")


same("bench_join_parent", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25")


@query("""
SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name HAVING count(*) > 5""")
def bench_fact_dictionary(spark, sf):
    df = navigate(spark, sf, "orders", {"segment": "o_custkey.c_mktsegment", "nation": "o_custkey.c_nationkey.n_name", "price": "o_totalprice"})
    return df.groupBy("segment", "nation").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean")).filter("n > 5")
