import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import session
from quern.functions import registry
from quern.sources.catalog import Catalog
from tests.compare import rows_of

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType())])


def test_tables_change_as_a_whole(spark, tmp_path):
    session.apply(spark)
    c = Catalog(spark, f"file://{tmp_path}")
    c.create("People", SCHEMA, key="id", checks={"grown": "age >= 0"}, defaults={"name": "'nobody'"})
    rows = lambda *r: spark.createDataFrame(list(r), "id long, name string, age long")
    c.insert("people", rows((1, "a", 30), (2, "b", None)))
    assert c.insert("people", spark.createDataFrame([(3, 5)], "id long, age long")).first().name == "nobody"
    for bad in ((1, "x", 1), (None, "x", 1), (9, "x", -1)):
        with pytest.raises(ValueError):
            c.insert("people", rows(bad))
    assert c.table("people").count() == 3
    c.upsert("people", rows((2, "B", 2), (4, "d", 4)), ["id"], ["name"])
    c.update("people", F.col("id") == 4, age=F.lit(40).cast("long"))
    c.delete("people", F.col("age") > 35)
    assert rows_of(c.table("people")) == [("1", "a", "30"), ("2", "B", "None"), ("3", "nobody", "5")]
    assert c.as_of("people", number=2).count() == 2 and c.as_of("people", number=5).count() == 4
    assert c.as_of("people", micros=2**62).count() == 3
    with pytest.raises(ValueError):
        c.as_of("people", micros=0)
    c.add_column("people", "city", T.StringType(), "'here'")
    c.rename_column("people", "name", "called")
    c.drop_column("people", "age")
    assert c.table("people").columns == ["id", "called", "city"]
    assert {r.field: (r.type, r.is_key) for r in c.describe("people").collect()} == {"id": ("bigint", True), "called": ("string", False), "city": ("string", False)}
    assert {r.column_name: r.distinct_count for r in c.analyze("people").collect()} == {"id": 3, "called": 3, "city": 1}
    c.create("pets", T.StructType([T.StructField("owner", T.LongType())]), references={"owner": ("people", "id")})
    c.insert("pets", spark.createDataFrame([(1,), (None,)], "owner long"))
    with pytest.raises(ValueError):
        c.insert("pets", spark.createDataFrame([(77,)], "owner long"))
    assert rows_of(c.show_tables()) == [("people",), ("pets",)]
    c.truncate("pets")
    assert c.table("pets").count() == 0
    c.drop("pets")
    assert c.tables() == ["people"]


def test_functions_by_name(spark):
    registry.register_sql(spark, "quern_twice", "x BIGINT", "BIGINT", "x * 2")
    registry.register_table_sql(spark, "quern_upto", "n INT", "k BIGINT", "SELECT id FROM range(5) WHERE id < n")
    registry.register_scalar(spark, "quern_half", _half, "double")
    registry.register_aggregate(spark, "quern_middle", _middle, "double")
    assert spark.sql("SELECT quern_twice(21), quern_half(3.0D)").first()[:] == (42, 1.5)
    assert spark.sql("SELECT count(*) FROM quern_upto(3)").first()[0] == 3
    assert spark.sql("SELECT quern_middle(v) FROM VALUES (1D), (5D), (2D) AS t(v)").first()[0] == 2.0
    registry.register_table(spark, "quern_split", _Letters, "letter string")
    assert [r[0] for r in spark.sql("SELECT * FROM quern_split('ab')").collect()] == ["a", "b"]


import pandas as pd  # noqa: E402


def _half(s: pd.Series) -> pd.Series:
    return s / 2


def _middle(v: pd.Series) -> float:
    return float(v.median())


class _Letters:
    def eval(self, text: str):
        for ch in text:
            yield (ch,)
