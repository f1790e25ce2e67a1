"""Set operations and common table expressions."""

from __future__ import annotations

from quern.operators.relational import chain
from quern.plans.registry import query, same
from quern.sources.tables import table

A, B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000", "SELECT s_nationkey AS k FROM supplier"
for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    same(f"set_{_name}", f"{A} {_op} {B}")
same("set_order_limit", f"{A} UNION {B} ORDER BY k DESC LIMIT 5")
same("set_nulls_equal", "SELECT nullif(c_nationkey, 5) AS k FROM customer INTERSECT SELECT nullif(s_nationkey, 5) FROM supplier")


@query(f"SELECT k FROM (({A} UNION ALL {B}) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 9) t")
def set_left_to_right(spark, sf):
    a = table(spark, sf, "customer").filter("c_acctbal > 8000").selectExpr("c_nationkey AS k")
    b = table(spark, sf, "supplier").selectExpr("s_nationkey AS k")
    return chain(a, ("union all", b), ("intersect", table(spark, sf, "nation").filter("n_nationkey < 9").selectExpr("n_nationkey AS k")))


same("cte_chain", """
WITH spent(cust, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey),
     top AS (SELECT cust, total FROM spent WHERE total > 2000000)
SELECT c_name, round(total, 2) AS total, (SELECT count(*) FROM top) AS n FROM top JOIN customer ON cust = c_custkey""")
same("cte_recursive", """
WITH RECURSIVE walk(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 % 1000007 FROM walk WHERE n < 150)
SELECT n, f FROM walk""")
same("cte_recursive_tree", """
WITH RECURSIVE tree(k, up, depth) AS (
  SELECT n_nationkey, CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM nation WHERE n_nationkey = 0
  UNION ALL SELECT c.n_nationkey, CAST(t.k AS BIGINT), t.depth + 1 FROM nation c JOIN tree t ON c.n_nationkey > 0 AND (c.n_nationkey - CASE WHEN c.n_nationkey % 2 = 0 THEN 2 ELSE 1 END) / 2 = t.k)
SELECT k, up, depth FROM tree""")
