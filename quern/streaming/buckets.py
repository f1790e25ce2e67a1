"""Time buckets over streams: the batch aggregates with a watermark, so state stays bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def bucketed(events: DataFrame, at: str, length: str, by: Sequence[str], aggregates: Sequence[Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling (or, with slide, overlapping) buckets of event time; rows over `late` behind are dropped once their bucket is closed."""
    made = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return made.groupBy(window.alias("bucket"), *by).agg(*aggregates).select(F.col("bucket.start").alias("bucket_start"), F.col("bucket.end").alias("bucket_end"), *by, *[_name(a) for a in aggregates])


def sessions(events: DataFrame, at: str, gap: str, by: Sequence[str], aggregates: Sequence[Column], late: str = "10 minutes") -> DataFrame:
    """Runs of events of one key with less than `gap` between neighbours."""
    made = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return made.groupBy(F.session_window(at, gap).alias("session"), *by).agg(*aggregates).select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *by, *[_name(a) for a in aggregates])


def _name(aggregate: Column) -> Column:
    """The column an aliased aggregate has become."""
    return F.col("`" + str(aggregate._jc.toString()).rpartition(" AS ")[2] + "`")


def write_once(df: DataFrame, target: str, checkpoint: str, mode: str = "append"):
    """Runs what there is to read and stops: every bucket reaches the target exactly once."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
