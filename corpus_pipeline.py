"""A corpus pipeline from the operators of quern.llm: run(spark, sf_dir) applies STAGES, in order, to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup, language, near_dedup, packing, quality
from quern.llm.common import discard, materialise, read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, learnt from this stage's labelled input, rejects.

    Null and empty texts are scored as an empty chunk; rows with a null id are judged but never learnt from; repeated rows
    fare alike; an empty table stays empty. Without labels all documents stay.
    """
    return quality.keep_good(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language or with an ambiguous one: null and empty texts and those without a letter too.

    Repeated rows fare alike, null ids as their text does; an empty table stays empty.
    """
    return language.keep_identified(docs, language.learn(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, one of repeated rows. Null text equals empty text, a null id is the
    least; an empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, from the similarity of stages on, stays: the one with the least
    id. Texts without words and rows with a null id all stay; an empty table stays empty."""
    return near_dedup.drop_near_copies(docs, percent=near_dedup.STAGE_PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences for training. A null or empty text is a piece of the end id alone; repeated rows
    and null ids are packed like any other; an empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("packing", packed),
]
#: The classifiers cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(before)  # nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)
