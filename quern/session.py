"""The session that the engine is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What query semantics rest on; sizes and cluster settings are left to the deployment.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "10000",
}


def session(name: str = "quern", **more: str) -> SparkSession:
    return apply(SparkSession.builder.appName(name).config(map={**SEMANTICS, **more}).getOrCreate())


def apply(spark: SparkSession) -> SparkSession:
    """Puts the settings that can change at run time on a session made elsewhere."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark
