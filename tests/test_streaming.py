from pyspark.sql import functions as F

from quern.streaming.buckets import bucketed, read_stream, sessions, write_once
from tests.conftest import DATA


def test_stream_equals_batch(spark, tmp_path):
    """All buckets but those still open at the watermark come out, as the batch gives them."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    aggregates = [F.count("*").alias("n"), F.max("value").alias("most")]
    stream = bucketed(read_stream(spark, str(tmp_path / "in"), events.schema), "ts", "1 day", ["event_type"], aggregates)
    write_once(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in bucketed(events, "ts", "1 day", ["event_type"], aggregates).collect()}
    assert got <= batch and len(got) > 0.8 * len(batch)


def test_sessions(spark):
    df = spark.sql("SELECT 1 AS u, CAST(t AS timestamp_ntz) AS ts FROM VALUES ('2024-01-01 00:00:00'), ('2024-01-01 00:04:00'), ('2024-01-01 01:00:00') AS v(t)")
    assert sorted(r.n for r in sessions(df, "ts", "5 minutes", ["u"], [F.count("*").alias("n")]).collect()) == [1, 2]
