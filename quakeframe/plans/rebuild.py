"""Reference catalogs as versions of a table: each rebuild relocates all events of a span and becomes a new version, in whole or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import merge_keep_ids, with_processing
from ..schema import Catalog
from .relocate import Options, only_moved, relocate_catalog, relocate_in_two_steps

TABLES = ("stations", "events", "phases")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, which have a row in the log."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return []
    return sorted(r.version for r in spark.read.parquet(f"{path}/log").select("version").distinct().collect())


def publish(cat: Catalog, path: str) -> int:
    """Writes a catalog as the next version. Its row in the log comes last, so readers never see part of one."""
    spark = cat.events.sparkSession
    number = max(versions(spark, path), default=0) + 1
    for name in TABLES:
        getattr(cat, name).write.mode("overwrite").parquet(f"{path}/version={number}/{name}")
    spark.range(1).select(F.lit(number).alias("version")).write.mode("append").parquet(f"{path}/log")
    return number


def current(spark: SparkSession, path: str, number: int | None = None) -> Catalog:
    known = versions(spark, path)
    if not known or number is not None and number not in known:
        raise ValueError(f"{path} has no version {number or ''}")
    return Catalog(*(spark.read.parquet(f"{path}/version={number or known[-1]}/{name}") for name in TABLES))


def moved(events: DataFrame, result: DataFrame) -> DataFrame:
    """events at the places of a relocation's result; those that it doesn't have, or hasn't moved, stay."""
    new = only_moved(result).select(F.col("event_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("latitude", "longitude", "depth", "t_us")])
    both = events.join(new, "id", "left")
    return both.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("latitude", "longitude", "depth", "t_us")}).select(*events.columns, F.col("_t_us").isNotNull().alias("relocated"))


def rebuild(cat: Catalog, path: str, o: Options, p: list[str], s: list[str], classes: list[float], xcorr: DataFrame | None = None) -> int:
    """Relocates a catalog and publishes it; the number of the version."""
    result = relocate_catalog(cat, with_processing(cat, p, s, classes), o, xcorr)
    return publish(Catalog(cat.stations, moved(cat.events, result), cat.phases), path)


def relocating(path: str, phases: Callable[[DataFrame], DataFrame], o: Options, p: list[str], s: list[str], classes: list[float]) -> Callable[[DataFrame], DataFrame]:
    """A handler for ``realtime.run_jobs``: each batch's events (id, t_us, latitude, longitude, depth), with the phases that ``phases`` finds for them,
    against the version that is current when the batch begins."""

    def handle(batch: DataFrame) -> DataFrame:
        background = current(batch.sparkSession, path)
        events = batch.select("id", "t_us", "latitude", "longitude", "depth").dropDuplicates(["id"])
        new = Catalog(background.stations, events, phases(events))
        picks = with_processing(merge_keep_ids(background, new), p, s, classes)
        return relocate_in_two_steps(background, new, picks, o)

    return handle
