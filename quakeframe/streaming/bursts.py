"""Bursts of updates as state of a key: a timer for each burst's end, which a later update replaces, gives out its last update when silence has lasted.

Needs the RocksDB state store (``use_state_store``)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType


def use_state_store(spark: SparkSession) -> None:
    """Timers and several states of a key are kept by this store alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def plain(value):
    """A cell of a pandas frame as what Spark takes."""
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    value = value.to_pydatetime() if isinstance(value, pd.Timestamp) else value
    return value.item() if hasattr(value, "item") else value


class Bursts(StatefulProcessor):
    """``waiting`` has the key's updates that haven't been given out, by their time in microseconds; of several with one time the first counts. In processing
    time an update waits from when it comes in, and what is left of a key after ``keep_ms`` is forgotten."""

    def __init__(self, state: str, columns: list[str], key: str, time: str, delay_us: int, event_time: bool, keep_ms: int | None):
        self.state, self.columns, self.key, self.time = state, columns, key, time
        self.delay_us, self.event_time, self.keep_ms = delay_us, event_time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = StructType.fromJson(json.loads(self.state))
        self.waiting = handle.getMapState("waiting", StructType([StructField("time_us", LongType())]), schema, None if self.event_time else self.keep_ms)

    def bursts(self) -> list[list[int]]:
        """Times of each burst, as session windows have them."""
        out: list[list[int]] = []
        for t in sorted(k[0] for k in self.waiting.keys()):
            if out and t - out[-1][-1] <= self.delay_us:
                out[-1].append(t)
            else:
                out.append([t])
        return out

    def due(self, burst: list[int]) -> int:
        return burst[-1] + self.delay_us

    def wait(self, wanted: set[int]) -> None:
        set_now = set(self.handle.listTimers())
        for t in set_now - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - set_now:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            for row in df[[self.time, *self.columns]].itertuples(index=False):
                at = (int(pd.Timestamp(row[0]).value // 1000),)
                if not self.waiting.containsKey(at):
                    self.waiting.updateValue(at, tuple(map(plain, row[1:])) or (None,))
        if self.event_time:
            self.wait({-(-self.due(b) // 1000) for b in self.bursts()})
        else:
            self.wait({timerValues.getCurrentProcessingTimeInMs() + self.delay_us // 1000})
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = expiredTimerInfo.getExpiryTimeInMs()
        bursts = [b for b in self.bursts() if -(-self.due(b) // 1000) <= ended] if self.event_time else [b for b in [sorted(k[0] for k in self.waiting.keys())] if b]
        for burst in bursts:
            last = self.waiting.getValue((burst[-1],))
            out = {self.key: [key[0]], self.time: [pd.Timestamp(burst[-1] * 1000)], **{c: [v] for c, v in zip(self.columns, last, strict=False)}}
            out |= {"updates": [len(burst)], "due": [pd.Timestamp(self.due(burst) * 1000)]}
            for t in burst:
                self.waiting.removeKey((t,))
            yield pd.DataFrame(out).astype({c: object for c in self.columns})


def debounced_by_state(updates: DataFrame, delay_s: float, late: str = "1 minute", key: str = "public_id", time: str = "time", event_time: bool = True, keep_s: float = 3600.0) -> DataFrame:
    """A stream's last update of each burst, as ``realtime.debounced`` has it after ``realtime.latest``: given out once the watermark has passed its
    end, or, if not in event time, once the clock is ``delay_s`` past the last update's arrival."""
    columns = [c for c in updates.columns if c not in (key, time)]
    fields = {f.name: f for f in updates.schema.fields}
    state = StructType([fields[c] for c in columns] or [StructField("none", LongType())])
    result = StructType([fields[key], fields[time], *(fields[c] for c in columns), StructField("updates", LongType()), StructField("due", TimestampType())])
    rows = updates.withWatermark(time, late) if event_time else updates
    processor = Bursts(json.dumps(state.jsonValue()), columns, key, time, round(delay_s * 1e6), event_time, round(keep_s * 1000))
    return rows.groupBy(key).transformWithStateInPandas(processor, result, "Append", "EventTime" if event_time else "ProcessingTime")
