"""Real-time operators: bursts of updates become one job, jobs go to profiles by region, and results are written once for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def debounced(updates: DataFrame, delay: str = "10 seconds", late: str | None = "1 minute", key: str = "public_id", time: str = "time") -> DataFrame:
    """The last update of each burst: updates of one key that follow each other within ``delay``. On a stream a burst is given
    out once the watermark has passed its end; on a table all are. ``late`` None keeps the watermark that the stream has, as after ``latest``."""
    rest = [c for c in updates.columns if c not in (key, time)]
    rows = updates.withWatermark(time, late) if updates.isStreaming and late else updates
    last = F.max(F.struct(F.col(time), *map(F.col, rest)))
    found = rows.groupBy(key, F.session_window(time, delay).alias("burst")).agg(last.alias("last"), F.count("*").alias("updates"))
    return found.select(key, "last.*", "updates", F.col("burst.end").alias("due"))


def latest(updates: DataFrame, late: str, key: str = "public_id", time: str = "time") -> DataFrame:
    """Updates without repeats of one key and time, as a store of objects keeps them for ``late``."""
    return updates.withWatermark(time, late).dropDuplicatesWithinWatermark([key, time]) if updates.isStreaming else updates.dropDuplicates([key, time])


def routed(origins: DataFrame, profiles: list[tuple[str, Column]]) -> DataFrame:
    """Origins with the first profile whose region holds them; others go."""
    name = None
    for profile, inside in profiles:
        name = F.when(inside, profile) if name is None else name.when(inside, profile)
    return origins.withColumn("profile", name).where("profile is not null")


def counts(events: DataFrame, width: str, slide: str | None = None, key: str = "key", time: str = "time", late: str = "1 minute") -> DataFrame:
    """Events of each key in tumbling or sliding windows."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_jobs(jobs: DataFrame, handle: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch of jobs through ``handle`` into a folder of its own, so that a batch that is run again replaces itself."""

    def once(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return jobs.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def joined_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str = "1 minute") -> DataFrame:
    """Each row of ``left`` with those of ``right`` that have its key and a time not before its own and not more than ``within`` after it; NULLs if none has.
    On streams both sides are kept as long as a partner may come, which their watermarks tell; a row without one is given out once, when none may any
    more. The key stays once, so other columns need names of their own."""
    if left.isStreaming:
        left, right = left.withWatermark(left_time, late), right.withWatermark(right_time, late)
    right = right.withColumnRenamed(key, "_key")
    after = F.col(right_time).between(F.col(left_time), F.col(left_time) + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col(key) == F.col("_key")) & after, "left").drop("_key")
