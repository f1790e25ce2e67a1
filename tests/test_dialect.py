import pytest

from quern import session
from quern.plans.dialect import run, translate
from quern.sources.tables import register
from tests.compare import rows_of
from tests.conftest import DATA


def test_text():
    assert translate("SELECT a FROM t ORDER BY a, b DESC, c NULLS FIRST LIMIT 3") == "SELECT a FROM t ORDER BY a NULLS LAST , b DESC NULLS FIRST , c NULLS FIRST LIMIT 3"
    assert translate("select rank() over (order by x rows unbounded preceding) from t") == "select rank ( ) over ( order by x NULLS LAST rows unbounded preceding ) from t"
    assert translate('SELECT "a b" FROM t OFFSET 5 ROWS FETCH NEXT 7 ROWS ONLY;') == "SELECT `a b` FROM t LIMIT 7 OFFSET 5"
    assert translate("SELECT 'x -- ''y' -- note\n, 1") == "SELECT 'x -- ''y' , 1"
    assert translate("SELECT stddev(x), log(x), log(2, x), concat(a, b) FROM t") == "SELECT stddev_pop ( x ) , ( CASE WHEN ( x ) > 0 THEN log10 ( ( x ) ) END ) , ( CASE WHEN ( 2 ) > 0 AND ( 2 ) <> 1 AND ( x ) > 0 THEN ln ( ( x ) ) / nullif ( ln ( ( 2 ) ) , 0 ) END ) , concat_ws ( '' , a , b ) FROM t"
    with pytest.raises(ValueError):
        translate("SELECT (1")


SAME = [
    ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",) * 2,
    ("SELECT count(*) AS n FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_acctbal > 5000)",) * 2,
    ("SELECT count(*) AS n FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier) OR c_custkey = ANY (SELECT s_suppkey FROM supplier)",) * 2,
    ("SELECT count(*) AS n FROM customer WHERE c_nationkey <> ALL (SELECT s_nationkey FROM supplier)",) * 2,
    ("SELECT count(*) AS n FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_suppkey < 0)",) * 2,
    ("SELECT doc_id FROM documents WHERE source GLOB 'src1?'",) * 2,
    ("SELECT p_partkey FROM part WHERE p_size > 10 XOR p_retailprice > 1200", "SELECT p_partkey FROM part WHERE (p_size > 10) <> (p_retailprice > 1200)"),
    ("SELECT o_orderkey FROM orders ORDER BY nullif(o_orderstatus, 'O'), o_orderkey FETCH FIRST 9 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY nullif(o_orderstatus, 'O') NULLS LAST, o_orderkey LIMIT 9"),
    ("SELECT c_nationkey, round(stddev(c_acctbal), 4) AS s FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, round(stddev_pop(c_acctbal), 4) AS s FROM customer GROUP BY c_nationkey"),
    ("SELECT a.vec_id, round(a.embedding <=> b.embedding, 4) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = 1",
     "SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = 1"),
]


@pytest.mark.parametrize("ours, theirs", SAME)
def test_same_rows_as_the_oracle(spark, duck, ours, theirs):
    session.apply(spark)
    register(spark, DATA)
    from tests.compare import plain

    assert rows_of(run(spark, ours)) == sorted(tuple(plain(v) for v in r) for r in duck.execute(theirs).fetchall())


#: What the engine gives for an expression, by its rules.
VALUES = [
    ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0e0", 3.5), ("1 / 0", None), ("9 / 2 / 2", 2), ("9 / (1 + 1) * 3", 12), ("7 % 0", None), ("mod(7, 4)", 3), ("1 + 6 / 4", 2), ("(8 + 1) / 2 + 1 / 2.0e0", 4.5),
    ("greatest(1, NULL)", None), ("greatest(1, 3, 2)", 3), ("least(2, 1)", 1), ("sqrt(-1)", None), ("sqrt(9)", 3.0), ("ln(0)", None), ("log(100)", 2.0), ("log(2, 8)", 3.0), ("log2(-1)", None),
    ("substring('abc', -2, 2)", "ab"), ("substr('abcdef', 3)", "cdef"), ("substring('abc', 2, -1)", ""), ("substring('abc', NULL, 1)", None), ("trim('\u00a0 a\u2003')", "a"), ("char(300)", "Ĭ"), ("char(55296)", None),
    ("extract(dow FROM TIMESTAMP '2024-03-10 00:00:00')", 0), ("extract(isodow FROM TIMESTAMP '2024-03-10 00:00:00')", 7), ("extract(year FROM DATE '2024-03-10')", 2024),
    ("datediff(TIMESTAMP '2024-03-11 23:00:00', TIMESTAMP '2024-03-10 23:30:00')", 0), ("iif(0, 1, 2)", 2), ("iif('yes', 1, 2)", 1), ("iif('no', 1, 2)", 2), ("iif(NULL, 1, 2)", 2), ("sign(-2.5)", -1),
    ("typeof(1)", "INTEGER"), ("typeof('x')", "TEXT"), ("typeof(1.5e0)", "FLOAT"), ("typeof(NULL)", "NULL"), ("json_typeof('[1]')", "array"), ("json_type('{\"a\": 1}')", "object"),
    ("'{\"a\": {\"b\": [1, \"x\"]}}' -> 'a' -> 'b'", '[1,"x"]'), ("'{\"a\": {\"b\": [1, \"x\"]}}' -> 'a' -> 'b' ->> 1", "x"), ("'{\"a\": \"t\"}' -> 'a'", '"t"'), ("'{\"a\": \"t\"}' ->> 'a'", "t"),
    ("vec_norm(array(3, 4))", 5.0), ("vec_distance_ip(array(1, 2), array(3, 4))", -11.0), ("vec_distance_l2(array(0, 0), array(3, 4))", 5.0), ("vec_distance_cosine(array(1, 0), array(0, 1))", 1.0), ("vec_dims(array(1, 2))", 2),
    ("CAST(time_trunc('15m', TIMESTAMP '2024-03-10 10:22:33') AS STRING)", "2024-03-10 10:15:00"), ("to_char(TIMESTAMP '2024-03-10 10:22:33', 'YYYY-MM-DD HH24:MI')", "2024-03-10 10:22"),
    ("CAST(civil_to_timestamptz(TIMESTAMP '2024-07-01 12:00:00', 'Europe/Berlin') AS STRING)", "2024-07-01 10:00:00"), ("CAST(timestamptz_to_civil(TIMESTAMP '2024-07-01 12:00:00', 'Europe/Berlin') AS STRING)", "2024-07-01 14:00:00"),
    ("typeof(now())", "TIMESTAMPTZ"), ("typeof(current_date)", "DATE"), ("random() BETWEEN 0 AND 1", True), ("concat('a', NULL, 'b')", "ab"), ("(SELECT first(a) FROM VALUES (NULL, 1), (2, 2) AS t(a, b))", 2),
    ("(SELECT first(a ORDER BY b DESC) FROM VALUES (1, 1), (2, 3), (NULL, 4) AS t(a, b))", 2), ("(SELECT last(a ORDER BY b) FROM VALUES (1, 1), (2, 3), (NULL, 4) AS t(a, b))", 2), ("(SELECT sum(value) FROM generate_series(1, 5, 2))", 9),
    ("(SELECT max(x / 4) FROM VALUES (7), (9) AS t(x))", 2),
]


def test_values(spark):
    """All in one query, which also shows that they stand beside one another."""
    session.apply(spark)
    got = run(spark, "SELECT " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(VALUES))).first()
    for (e, want), v in zip(VALUES, got, strict=True):
        assert v == want or (isinstance(want, float) and abs(v - want) < 1e-9), (e, v, want)
    assert run(spark, "SELECT 7 / 2 AS q").dtypes == [("q", "bigint")]


def test_set_operations_run_from_left_to_right(spark):
    value = lambda sql: sorted(r[0] for r in run(spark, sql).collect())
    assert value("SELECT 1 UNION SELECT 2 INTERSECT SELECT 3") == []
    assert value("SELECT 1 UNION SELECT 2 INTERSECT SELECT 2 ORDER BY 1 LIMIT 5") == [2]
    assert value("WITH t AS (SELECT 3 AS a) SELECT 1 AS a UNION ALL SELECT a FROM t INTERSECT SELECT 3") == [3]
    assert value("SELECT 1 UNION (SELECT 2 INTERSECT SELECT 3)") == [1]


def test_paths_over_references(spark, duck):
    session.apply(spark)
    register(spark, DATA)
    ours = "SELECT l.l_orderkey.o_custkey.c_nationkey.n_name AS nation, count(*) AS n FROM lineitem l WHERE l.l_orderkey.o_custkey.c_nationkey.n_regionkey.r_name = 'ASIA' GROUP BY l.l_orderkey.o_custkey.c_nationkey.n_name"
    theirs = "SELECT n_name, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1"
    assert sorted(map(tuple, run(spark, ours).collect())) == sorted(duck.execute(theirs).fetchall())
    assert translate(ours).count("LEFT JOIN") == 4
    assert run(spark, "SELECT o_custkey.c_name FROM orders ORDER BY o_orderkey LIMIT 1").first()[0].startswith("Customer")
    with pytest.raises(ValueError, match="no reference"):
        translate("SELECT o.o_totalprice.c_name FROM orders o")


def test_parameters(spark):
    assert run(spark, "SELECT ? + 1 AS a, ? AS b", [1, "x"]).first() == (2, "x")
    assert run(spark, "SELECT $2 AS a, $1 AS b, $2 AS c", [1, "x"]).first() == ("x", 1, "x")
    assert run(spark, "SELECT :v / 2 AS a, 'a:b' AS c, 1::STRING AS s", {"v": 7}).first() == (3, "a:b", "1")


@pytest.mark.parametrize("sql", ["SELECT a FROM t QUALIFY row_number() OVER (ORDER BY a) = 1", "SELECT 1 FROM t, LATERAL (SELECT 1)", "SELECT a, b FROM t GROUP BY a, ROLLUP(b)"])
def test_refused(sql):
    with pytest.raises(ValueError):
        translate(sql)


@pytest.mark.parametrize("test, n", [("= ALL (SELECT x FROM VALUES (2), (2) AS t(x))", 1), ("= ALL (SELECT x FROM VALUES (2), (3) AS t(x))", 0), ("<> ANY (SELECT x FROM VALUES (2), (3) AS t(x))", 3), ("<> ANY (SELECT x FROM VALUES (2) AS t(x))", 2), ("= ALL (SELECT x FROM VALUES (2) AS t(x) WHERE x > 5)", 3)])
def test_equal_all_and_different_any(spark, test, n):
    assert run(spark, f"SELECT count(*) FROM VALUES (1), (2), (3) AS s(v) WHERE v {test}").first()[0] == n
