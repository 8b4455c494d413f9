"""Bursts of updates on a stream give what they give on a table."""

from pyspark.sql import functions as F

from quakeframe.streaming import realtime

ROWS = [("a", 0, 1), ("a", 5, 2), ("a", 30, 3), ("b", 2, 4), ("b", 2, 4), ("b", 100, 5), ("z", 4000, 6)]


def test_debounce_on_a_stream(spark, tmp_path):
    table = spark.createDataFrame(ROWS, "public_id string, s long, seq long").select("public_id", F.timestamp_seconds(F.col("s") + 1_600_000_000).alias("time"), "seq")
    table.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    jobs = realtime.debounced(realtime.latest(stream, "5 seconds"), "10 seconds", late=None)
    q = realtime.run_jobs(jobs, lambda b: b.withColumn("done", F.lit(True)), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True)
    q.awaitTermination()
    got = sorted((r.public_id, r.seq, r.updates) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    whole = sorted((r.public_id, r.seq, r.updates) for r in realtime.debounced(realtime.latest(table, "1 hour"), "10 seconds").collect())
    assert whole == [("a", 2, 2), ("a", 3, 1), ("b", 4, 1), ("b", 5, 1), ("z", 6, 1)]
    assert got == whole[:-1]  # the watermark has not passed the last burst


def test_first_profile_wins(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 9.0)], "id long, x double")
    got = realtime.routed(df, [("low", F.col("x") < 6), ("mid", F.col("x") < 7)])
    assert {(r.id, r.profile) for r in got.collect()} == {(1, "low"), (2, "low")}
