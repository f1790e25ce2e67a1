"""Operators on small tables with nulls, copies and empty sides."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import session
from quern.functions import scalar as S
from quern.operators import relational as R
from quern.operators import versions as V
from quern.sources.files import copy_csv, copy_json
from tests.compare import rows_of
from tests.conftest import DATA


@pytest.fixture
def t(spark):
    session.apply(spark)
    return spark.createDataFrame([(1, 5), (2, None), (3, 7), (3, 7)], "k long, v long")


def test_any_and_all(spark, t):
    right = spark.createDataFrame([(5,), (6,)], "x long")
    nulls = right.unionAll(spark.createDataFrame([(None,)], "x long"))
    keys = lambda df: sorted(r[0] for r in df.collect())
    assert keys(R.compare_any(t, "v", ">", right, "x")) == [3, 3]
    assert keys(R.compare_any(t, "v", "=", nulls, "x")) == [1]
    assert keys(R.compare_all(t, "v", ">", right, "x")) == [3, 3]
    assert keys(R.compare_all(t, "v", ">", nulls, "x")) == []
    assert keys(R.compare_all(t, "v", ">", right.limit(0), "x")) == [1, 2, 3, 3]
    assert keys(R.compare_all(t, "v", "<>", right, "x")) == [3, 3]
    assert keys(R.compare_all(t, "v", "<>", nulls, "x")) == []
    assert keys(R.compare_all(t, "v", "<>", right.limit(0), "x")) == [1, 2, 3, 3]


def test_sets_run_left_to_right(spark):
    one = lambda n: spark.range(n, n + 1)
    assert rows_of(R.chain(one(1), ("union all", one(2)), ("intersect", one(2)))) == [("2",)]


def test_distinct_on_and_top_n(t):
    assert rows_of(R.distinct_on(t, ["k"], [S.desc("v")])) == [("1", "5"), ("2", "None"), ("3", "7")]
    assert [r.v for r in R.top_n(t, [S.asc("v")], 2, 2).collect()] == [7, None]


@pytest.mark.parametrize("rows, least", [(100_000, 64), (100_000, 1), (7, 1), (1, 1)])
def test_numbers_of_both_orders(spark, rows, least):
    """Null keys, a frequent key, null ties, keys beyond all cuts, one key alone, no row."""
    data = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i // 7, None if i == 91 else i) for i in range(300)] + [(2**60, -1), (-(2**60), -2)]
    for some in (data, [(None, i) for i in range(50)], [(5, i) for i in range(50)], [(1, None)], []):
        got = R.numbered(spark.createDataFrame(some, "k long, t long").repartition(3), "k", "t", "up", "down", rows, least)
        tie = lambda r: (r[1] is None, r[1] or 0)
        up = sorted(some, key=lambda r: (r[0] is None, r[0] or 0, tie(r)))
        down = sorted(some, key=lambda r: (r[0] is not None, -(r[0] or 0), tie(r)))
        assert got.dtypes == [("k", "bigint"), ("t", "bigint"), ("up", "bigint"), ("down", "bigint")]
        assert sorted((r.up, r.k, r.t) for r in got.collect()) == [(i, *r) for i, r in enumerate(up, 1)]
        assert sorted((r.down, r.k, r.t) for r in got.collect()) == [(i, *r) for i, r in enumerate(down, 1)]


def test_parts_of_numbered_rows_grow_in_number_not_in_size(spark):
    """A frequent key and null keys are split; parts keep their size on ten times the rows; both numbers come of one shuffle of the rows."""
    for n in (3_000, 30_000):
        df = spark.range(n).select(F.when(F.col("id") % 3 == 1, 5).when(F.col("id") % 3 == 2, F.col("id")).alias("k"), "id")
        laid = R.parted(df, "k", "id", rows=500, least=1)
        most = [r["n"] for r in laid.groupBy("quern_a", "quern_b").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()]
        assert sum(most) == n and most[0] <= 1500 and len(most) >= n // 500 - 2
    plan = R.numbered(df, "k", "id", "up", "down", 500, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(quern_a") == 2  # the rows, and the counts of the parts


def test_navigation_rejects_what_is_no_reference(spark):
    with pytest.raises(ValueError):
        R.navigate(spark, DATA, "orders", {"x": "o_totalprice.c_name"})


def test_series(spark):
    values = lambda df: [r[0] for r in df.collect()]
    assert values(R.generate_series(spark, 3, 1)) == [3, 2, 1]
    assert values(R.generate_series(spark, 1, 5, 2)) == [1, 3, 5]
    assert values(R.generate_series(spark, 1, 5, -1)) == []
    with pytest.raises(ValueError):
        R.generate_series(spark, 1, 2, 0)


def test_changes(spark, t):
    new = spark.createDataFrame([(1, 9), (4, 4)], "k long, v long")
    base = t.dropDuplicates(["k"])
    assert rows_of(V.upsert(base, new, ["k"], ["v"])) == [("1", "9"), ("2", "None"), ("3", "7"), ("4", "4")]
    assert rows_of(V.upsert(base, new, ["k"])) == [("1", "5"), ("2", "None"), ("3", "7"), ("4", "4")]
    assert rows_of(V.delete(t, F.col("v") > 5)) == [("1", "5"), ("2", "None")]
    assert rows_of(V.update(base, F.col("v") > 5, v=F.lit(0).cast("long"))) == [("1", "5"), ("2", "None"), ("3", "0")]
    with pytest.raises(ValueError):
        V.insert(base, new, "k")


def test_copy(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("ok", T.BooleanType())])
    (tmp_path / "a.csv").write_text('ID,ok,name\n1,yes,"a ""b"""\n2,0,\n')
    assert rows_of(copy_csv(spark, str(tmp_path / "a.csv"), schema)) == [("1", 'a "b"', "True"), ("2", "None", "False")]
    (tmp_path / "a.json").write_text('[{"Id": 1, "NAME": "x"}, {"id": null, "ok": "t"}]'.replace('"id": null', '"Id": null'))
    assert rows_of(copy_json(spark, str(tmp_path / "a.json"), schema, lines=False)) == [("1", "x", "None"), ("None", "None", "True")]
    (tmp_path / "b.csv").write_text("id,other\n1,2\n")
    with pytest.raises(ValueError):
        copy_csv(spark, str(tmp_path / "b.csv"), schema)
    (tmp_path / "c.csv").write_text("id,name,ok\nx,y,true\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        copy_csv(spark, str(tmp_path / "c.csv"), schema).collect()


@pytest.mark.parametrize("how, rows", [("inner", 4), ("left", 6), ("right", 5), ("full", 7), ("left_semi", 2), ("left_anti", 2)])
def test_join_matrix(spark, how, rows):
    """Null keys never match; copies multiply; each side has a key that the other lacks."""
    a = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k long")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, v string")
    assert a.join(b, "k", how).count() == rows
    assert a.limit(0).join(b, "k", how).count() == (3 if how in ("right", "full") else 0)
