"""The sample to learn from holds every group, however many there are and however the table is laid out."""

import collections

import pytest
from pyspark.sql import functions as F

from quern.llm import language
from quern.llm.common import share_sample


@pytest.fixture(scope="module")
def many(spark):
    """70 languages of 100 rows, laid out by language."""
    made = spark.range(0, 7000, 1, 14)
    return made.select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.floor(F.col("id") / 100).cast("string")).alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))


def test_every_group_is_in_the_sample(many):
    got = groups_of(share_sample(many, "lang", "doc_id", 100, 2100))
    assert len(got) == 70 and sum(got.values()) <= 2100 and min(got.values()) >= 10
    assert groups_of(share_sample(many, "lang", "doc_id", 100, 100_000)) == {f"l{i}": 100 for i in range(70)}


def groups_of(sample):
    return collections.Counter(r.grp for r in sample.collect())


def test_the_layout_of_the_table_does_not_count(many):
    take = lambda df: sorted(map(tuple, share_sample(df, "lang", "doc_id", 20, 2100).collect()))
    assert take(many) == take(many.repartition(3, "text"))


def test_more_groups_than_the_bound_are_an_error(many):
    with pytest.raises(ValueError, match="more than 69"):
        share_sample(many, "lang", "doc_id", 100, 2100, groups=69)
    with pytest.raises(ValueError, match="more than 69"):
        language.learn(many, groups=69)


def test_rows_that_share_a_key_push_no_group_out(spark, many):
    low = spark.range(100_000).filter("pmod(xxhash64(id, 17), 1 << 20) < 1000").first()[0]
    got = groups_of(share_sample(many.withColumn("doc_id", F.lit(low)), "lang", "doc_id", 100, 2100))
    assert len(got) == 70 and sum(got.values()) <= 2100


def test_a_hundred_languages_some_of_long_texts_alone(spark):
    """Every language is learnt, and two runs give one model."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i, k: "".join(letters[(i * 7 + j * (i % 11 + 3) + k % 5) % 26] for j in range(5 + k % 3))
    rows = [(i * 20 + k, f"l{i}", " ".join(word(i, k + j) for j in range(40 if i % 10 else 6000))) for i in range(100) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    one, two = language.learn(docs), language.learn(docs.repartition(5))
    assert one.languages == sorted({r[1] for r in rows}) and (one.weights == two.weights).all()
    assert set(one.predict([t for i, _, t in rows if i % 20 == 0])[0]) == set(one.languages)
