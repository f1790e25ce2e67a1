"""Projection, predicates, sorting and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators.relational import numbered, top_n
from quern.plans.registry import query, same
from quern.sources.tables import table

same("scan_project_filter", """
SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount), 5) AS revenue
FROM lineitem WHERE l_quantity < 5 AND l_discount >= 0.05 AND l_returnflag <> 'N'""")
same("predicates_null_logic", """
SELECT o_orderkey, nullif(o_orderstatus, 'O') IS NULL AS open,
       (nullif(o_orderstatus, 'O') = 'F' OR o_totalprice > 200000) AS either_one,
       (nullif(o_orderstatus, 'O') = 'F' AND o_totalprice > 200000) AS both_of,
       NOT (nullif(o_orderstatus, 'O') = 'F') AS negated,
       (nullif(o_orderstatus, 'O') = 'F') IS TRUE AS sure
FROM orders WHERE NOT (nullif(o_orderstatus, 'O') = 'F') OR o_orderstatus = 'O'""")
same("in_between_case", """
SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'medium' ELSE 'large' END AS kind,
       CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 0 END AS brand_no
FROM part WHERE p_size IN (1, 5, 10, 20, 40) AND p_retailprice NOT BETWEEN 1000 AND 1100""")
same("in_tuple", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW'))")
same("is_distinct_from", """
SELECT o_orderkey, nullif(o_orderstatus, 'O') IS DISTINCT FROM 'F' AS differs, nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM NULL AS same_as_null
FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F'""")
same("expr_alias_arith", """
SELECT s_suppkey, s_suppkey * 2 + 1 AS odd, -s_suppkey AS minus, round(s_acctbal / 7, 4) AS share, s_name || '/' || CAST(s_nationkey AS VARCHAR(10)) AS tag
FROM supplier""")


@query("""
SELECT doc_id, text LIKE '%the%' AS has_the, text ILIKE 'THE%' AS begins, text NOT LIKE '%zz%' AS no_zz,
       source GLOB 'src1*' AS glob_many, source GLOB 'src?' AS glob_one, regexp_matches(source, '^src[0-4]$') AS low_source,
       lang LIKE 'e_' AS e_lang, '100%' LIKE '100!%' ESCAPE '!' AS escaped
FROM documents""")
def like_ilike_regexp_glob(spark, sf):
    text, source = F.col("text"), F.col("source")
    return table(spark, sf, "documents").select(
        "doc_id", text.like("%the%").alias("has_the"), text.ilike("THE%").alias("begins"), (~text.like("%zz%")).alias("no_zz"),
        S.glob(source, "src1*").alias("glob_many"), S.glob(source, "src?").alias("glob_one"), source.rlike("^src[0-4]$").alias("low_source"),
        F.col("lang").like("e_").alias("e_lang"), F.expr("'100%' LIKE '100!%' ESCAPE '!'").alias("escaped"),
    )


@query("""
SELECT p_partkey, p_size & 7 AS bit_and, p_size | 8 AS bit_or, xor(p_size, 5) AS bit_xor, ~p_size AS bit_not,
       p_partkey << 2 AS left_two, p_partkey >> 1 AS right_one, (p_size > 10) <> (p_retailprice > 1200) AS logical_xor
FROM part""")
def bitwise_ops(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", size.bitwiseAND(7).alias("bit_and"), size.bitwiseOR(8).alias("bit_or"), size.bitwiseXOR(5).alias("bit_xor"), F.bitwise_not(size).alias("bit_not"),
        F.shiftleft(key, 2).alias("left_two"), F.shiftright(key, 1).alias("right_one"), S.xor(size > 10, F.col("p_retailprice") > 1200).alias("logical_xor"),
    )


@query("""
SELECT p_partkey, p_partkey // 7 AS by_seven, (-p_partkey) // 7 AS minus_by_seven,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey // (p_size % 5) END AS by_rest,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey % (p_size % 5) END AS rest,
       round(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice / (p_size % 5) END, 6) AS price_by_rest
FROM part""")
def arith_division(spark, sf):
    """Integers divide toward zero; by zero everything is null."""
    key, rest = F.col("p_partkey"), F.col("p_size") % 5
    return table(spark, sf, "part").select(
        "p_partkey", S.int_div(key, F.lit(7)).alias("by_seven"), S.int_div(-key, F.lit(7)).alias("minus_by_seven"),
        S.int_div(key, rest).alias("by_rest"), S.rem(key, rest).alias("rest"), F.round(S.div(F.col("p_retailprice"), rest), 6).alias("price_by_rest"),
    )


@query("""
SELECT row_number() OVER (ORDER BY CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END ASC NULLS LAST, o_orderkey) AS up,
       row_number() OVER (ORDER BY CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END DESC NULLS FIRST, o_orderkey) AS down, o_orderkey
FROM orders""")
def sort_nulls(spark, sf):
    """Null sorts as the largest value: last when rising, first when falling."""
    key = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey"))
    orders = table(spark, sf, "orders").select("o_orderkey", key.alias("k"))
    return numbered(orders, "k", "o_orderkey", "up", "down").select("up", "down", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topn(spark, sf):
    return top_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [S.desc("o_totalprice"), S.asc("o_orderkey")], 25)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 30")
def limit_offset(spark, sf):
    return top_n(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [S.asc("o_orderdate"), S.asc("o_orderkey")], 10, 30)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey OFFSET 5 ROWS FETCH NEXT 7 ROWS ONLY")
def fetch_first(spark, sf):
    return top_n(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [S.desc("c_acctbal"), S.asc("c_custkey")], 7, 5)


same("order_by_expression", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY count(*) DESC, 1 LIMIT 5")
same("bench_scan_full", """
SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS p, max(l_shipdate) AS latest, min(l_returnflag) AS flag, max(l_linestatus) AS status,
       sum(l_orderkey + l_partkey + l_suppkey + l_linenumber) % 1000003 AS keys FROM lineitem""")
same("bench_scan_projected", "SELECT round(sum(l_quantity), 2) AS q, count(l_orderkey) AS n FROM lineitem")
