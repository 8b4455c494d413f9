"""Bursts kept as state, and streams joined within an interval, with late and repeated rows and a restart, give what tables give."""

import shutil
import time

import pytest
from pyspark.sql import functions as F

from quakeframe.streaming import bursts, realtime

SCHEMA = "public_id string, s double, seq long, note string"


def at(df, column="time"):
    return df.withColumn(column, F.timestamp_micros((F.col("s") * 1e6 + 1.6e15).cast("long"))).drop("s")


def feed(spark, folder, name, rows, schema=SCHEMA, column="time"):
    """One file more for a stream, and so one batch more."""
    at(spark.createDataFrame(rows, schema), column).coalesce(1).write.parquet(f"{folder}/{name}.tmp")
    part = next(p for p in (folder / f"{name}.tmp").iterdir() if p.name.endswith(".parquet"))
    (folder / "in").mkdir(exist_ok=True)
    shutil.move(part, folder / "in" / f"{name}.parquet")
    time.sleep(0.02)


@pytest.fixture
def few_states(spark):
    bursts.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_bursts_as_state(spark, tmp_path, few_states):
    """Updates of one burst in several batches, out of order, repeated, and too late; the state outlives a restart."""
    batches = [
        [("a", 0.0, 1, "x"), ("a", 5.0, 2, None), ("b", 2.0, 4, "y")],
        [("a", 3.0, 7, "between"), ("a", 5.0, 2, None), ("a", 14.5, 3, "z"), ("b", 12.0, 8, "edge")],
        [("a", 60.0, 9, "w"), ("b", 22.000001, 10, None), ("c", 61.0, 11, "v")],
        [("c", 70.0, 12, "u")],
        [("a", 1.0, 99, "far too late"), ("c", 71.0, 13, "t")],
        [("z", 4000.0, 6, None)],
    ]
    schema = at(spark.createDataFrame([], SCHEMA)).schema
    (tmp_path / "in").mkdir()
    out = tmp_path / "out"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = bursts.debounced_by_state(stream, 10.0, "20 seconds")
        q = found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    for k, rows in enumerate(batches):
        feed(spark, tmp_path, f"{k}", rows)
        if k in (1, 5):
            run()  # the second run starts from the first one's state
    key = lambda r: (r.public_id, r.time, r.seq, r.note, r.updates, r.due)
    got = sorted(map(key, spark.read.parquet(str(out)).collect()), key=str)
    on_time = [r for b in batches for r in b if r[2] != 99]
    table = realtime.debounced(realtime.latest(at(spark.createDataFrame(on_time, SCHEMA)), "1 hour"), "10 seconds")
    assert got == sorted((key(r) for r in table.where("public_id <> 'z'").collect()), key=str) and len(got) == 5


def test_bursts_by_the_clock(spark, tmp_path, few_states):
    schema = at(spark.createDataFrame([], SCHEMA)).schema
    feed(spark, tmp_path, "0", [("a", 0.0, 1, "x"), ("a", 5.0, 2, None)])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = bursts.debounced_by_state(stream, 1.0, event_time=False, keep_s=600).writeStream.format("memory").queryName("clock").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            if got := spark.table("clock").collect():
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r.public_id, r.seq, r.updates) for r in got] == [("a", 2, 2)]


def test_streams_joined_within_an_interval(spark, tmp_path):
    """Partners that come first, later, or too late; rows without one are given out once."""
    sides = {"picks": ("id string, s double, pick long", "pick_time"), "origins": ("id string, s double, origin long", "origin_time")}
    batches = [
        {"picks": [("a", 0.0, 1), ("b", 1.0, 2)], "origins": [("b", 3.0, 20), ("x", 0.0, 21)]},
        {"picks": [("a", 9.0, 3), ("c", 8.0, 4)], "origins": [("a", 10.0, 22), ("b", 31.5, 23), ("c", 7.0, 24)]},
        {"picks": [("d", 500.0, 5)], "origins": [("d", 501.0, 25), ("z", 500.0, 26)]},
        {"picks": [("z", 510.0, 6)], "origins": [("z", 510.0, 29)]},
        {"picks": [("a", 2.0, 98)], "origins": [("b", 2.0, 99)]},
        {"picks": [("z", 4000.0, 7)], "origins": [("z", 4000.0, 27)]},
        {"picks": [("z", 4000.0, 8)], "origins": [("z", 4000.0, 28)]},
    ]
    streams = {}
    for name, (schema, column) in sides.items():
        (tmp_path / name / "in").mkdir(parents=True)
        for k, b in enumerate(batches):
            feed(spark, tmp_path / name, f"{k}", b[name], schema, column)
        streams[name] = spark.readStream.schema(at(spark.createDataFrame([], schema), column).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in"))
    found = realtime.joined_within(streams["picks"], streams["origins"], "id", "pick_time", "origin_time", "30 seconds", "1 minute")
    q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "pick", "origin").collect() if r.id != "z"), key=str)
    tables = [at(spark.createDataFrame([r for b in batches for r in b[n] if r[2] not in (98, 99)], sides[n][0]), sides[n][1]) for n in ("picks", "origins")]
    table = realtime.joined_within(*tables, "id", "pick_time", "origin_time", "30 seconds").where("id <> 'z'")
    assert got == sorted((tuple(r) for r in table.select("id", "pick", "origin").collect()), key=str)
    assert ("c", 4, None) in got and ("b", 2, 20) in got and ("b", 2, 23) not in got and ("a", 1, 22) in got and len(got) == 5
