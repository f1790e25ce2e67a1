"""Rules that differ from Spark's own, one by one."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern import session
from quern.functions import aggregate as A
from quern.functions import scalar as S


@pytest.fixture(autouse=True)
def semantics(spark):
    session.apply(spark)


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


L = F.lit


def null(kind):
    return F.lit(None).cast(kind)


def test_division(spark):
    assert one(spark, S.int_div(L(7), L(2)), S.int_div(L(-7), L(2)), S.int_div(L(7), L(0)), S.div(L(1), L(0)), S.rem(L(7), L(0))) == (3, -3, None, None, None)
    assert one(spark, S.int_div(L(2**62 + 1), L(1))) == (2**62 + 1,)


def test_null_in_null_out(spark):
    assert one(spark, S.greatest(L(1), null("int"), L(3)), S.least(L(1), L(2)), S.concat(L("a"), null("string"), L("b")), S.concat(null("string"))) == (None, 1, "ab", "")


def test_substring_and_split(spark):
    s = L("hello")
    assert one(spark, S.substring(s, L(-2), L(3)), S.substring(s, L(2), L(-1)), S.substring(s, L(4)), S.split_part(L("a,b"), ",", 5)) == ("hel", "", "lo", "")
    with pytest.raises(ValueError):
        S.split_part(s, ",", 0)


def test_replace_empty_and_char(spark):
    assert one(spark, S.replace(L("ab"), "", "-"), S.char(L(0x1F600)), S.char(L(0xD800)), S.char(L(65))) == ("-a-b-", "\U0001f600", None, "A")


def test_trim_takes_unicode_space(spark):
    assert one(spark, S.trim(L("　 a\t\n")), S.ltrim(L(" a ")), S.rtrim(L(" a "))) == ("a", "a ", " a")


def test_glob(spark):
    assert one(spark, S.glob(L("a.txt"), "*.txt"), S.glob(L("abtxt"), "*.txt"), S.glob(L("ab"), "a?"), S.glob(L("A"), "a")) == (True, False, True, False)


def test_logarithms(spark):
    assert one(spark, S.log(L(100.0)), S.log(L(-1.0)), S.sqrt(L(-1.0)), S.ln(L(0.0)), S.log(L(8.0), L(2.0))) == (2.0, None, None, None, 3.0)


def test_rounding(spark):
    assert one(spark, F.round(L(2.5)), F.round(L(-2.5)), S.truncate(L(-1.79), 1), S.floor(L(-1.5)), S.absolute(L(-(2**63)).cast("bigint"))) == (3.0, -3.0, -1.7, -2.0, None)


def test_dates(spark):
    ts = lambda s: L(s).cast("timestamp_ntz")
    sunday = ts("2024-03-03 10:11:12.345678")
    assert one(spark, S.dow(sunday), S.isodow(sunday), S.millisecond(sunday)) == (0, 7, 345)
    assert one(spark, S.datediff(ts("2024-01-02 02:00:00"), ts("2024-01-01 23:00:00")), S.datediff(ts("2024-01-01 00:00:00"), ts("2024-01-02 23:00:00"))) == (0, -1)
    assert str(one(spark, S.date_add(ts("2024-01-31 10:00:00.5"), 1, "month"))[0]) == "2024-02-29 10:00:00"
    assert one(spark, S.to_char(sunday, "Dy, DD Mon YYYY HH24:MI:SS")) == ("Sun, 03 Mar 2024 10:11:12",)
    assert str(one(spark, S.time_trunc("1h30m", sunday))[0]) == "2024-03-03 09:00:00"
    with pytest.raises(ValueError):
        S.micros("5x")


def test_json(spark):
    assert one(spark, S.json_valid(L("{")), S.json_valid(L('{"a":1}}')), S.json_valid(L("[1]")), S.json_extract(L('{"a":{"b":[1,2]}}'), "a.b[1]")) == (0, 0, 1, "2")
    assert one(spark, S.json_array(L(1), L("x"), null("int")), S.json_object(("b", L(1)), ("a", null("int"))), S.json_keys(L('{"z":1,"a":2}'))) == ('[1,"x",null]', '{"a":null,"b":1}', '["a","z"]')
    assert one(spark, S.json_type(L("[1]")), S.json_type(L("true")), S.json_type(L("null")), S.json_type(L("1.5")), S.json_type(L("{"))) == ("array", "boolean", "null", "number", None)


def test_truth_and_cast(spark):
    assert one(spark, S.truth(L("maybe"), "string"), S.truth(L("No"), "string"), S.iif(L(2), "int", L("y"), L("n")), S.float_text(L(1.5))) == (True, False, "y", "1.500000")


def test_vectors(spark):
    a, b = F.array(L(1.0), L(0.0)), F.array(L(0.0), L(2.0))
    assert one(spark, S.cosine_distance(a, b), S.inner_distance(a, b), S.norm(b), S.vector_text(a)) == (1.0, -0.0, 2.0, "[1.0, 0.0]")
    with pytest.raises(Exception, match="vectors differ"):
        one(spark, S.l2_distance(a, F.array(L(1.0))))


def test_aggregates(spark):
    df = spark.createDataFrame([Row(k=2, v="b"), Row(k=1, v=None), Row(k=3, v="a")])
    got = df.agg(A.first(F.col("v"), F.col("k")).alias("f"), A.last(F.col("v"), F.col("k")).alias("l"), A.array_agg(F.col("v"), F.col("k")).alias("j"), A.string_agg(F.col("v"), F.col("k")).alias("s")).first()
    assert tuple(got) == ("b", "a", '[null,"b","a"]', "b,a")
    assert tuple(df.limit(0).agg(A.array_agg(F.col("v")).alias("j"), A.string_agg(F.col("v")).alias("s")).first()) == (None, None)
    big = spark.range(3).agg(A.exact_sum(F.lit(2**63 - 1)).alias("s")).first()[0]
    assert big == 3 * (2**63 - 1)
