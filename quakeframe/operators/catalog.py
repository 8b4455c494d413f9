"""Changes and selections on catalogs: union, upsert, removal, extraction, and the weights and types of picks.

Where rows of one id meet, ``seq``-like order columns decide, never the order of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import phase_group, pick_weight
from ..schema import Catalog


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row that comes last."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def union_first(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """a, and the rows of b whose key a doesn't have."""
    return a.unionByName(b.join(a.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_keep_ids(a: Catalog, b: Catalog) -> Catalog:
    """Events of b whose id a has are left out, with their phases."""
    fresh = b.events.join(a.events.select("id"), "id", "left_anti")
    phases = b.phases.join(fresh.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return Catalog(union_first(a.stations, b.stations), a.events.unionByName(fresh, allowMissingColumns=True), a.phases.unionByName(phases, allowMissingColumns=True))


def renumbered(events: DataFrame, first: DataFrame) -> DataFrame:
    """(id, new_id): ids after the greatest of ``first``, in the order of id. Ranks come from a range partitioning, so no task has all events."""
    from .stats import ranked

    top = first.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return ranked(events.select("id"), ["id"]).crossJoin(F.broadcast(top)).select("id", (F.col("_top") + F.col("_rank")).alias("new_id"))  # one row


def merge_renumbered(a: Catalog, b: Catalog) -> Catalog:
    """All events of b, with new ids."""
    ids = renumbered(b.events, a.events)
    events = b.events.join(ids, "id").withColumn("id", F.col("new_id")).drop("new_id")
    phases = b.phases.join(ids.withColumnRenamed("id", "event_id"), "event_id").withColumn("event_id", F.col("new_id")).drop("new_id")
    return Catalog(union_first(a.stations, b.stations), a.events.unionByName(events, allowMissingColumns=True), a.phases.unionByName(phases, allowMissingColumns=True))


def upsert(base: DataFrame, changes: DataFrame, key: str = "id", add_missing: bool = True) -> DataFrame:
    """base with the rows of ``changes`` in place of its own; rows that base lacks are added if asked for."""
    if not add_missing:
        changes = changes.join(base.select(key), key, "left_semi")
    return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def remove_events(cat: Catalog, ids: DataFrame) -> Catalog:
    """Without some events (id) and their phases."""
    return Catalog(cat.stations, cat.events.join(ids, "id", "left_anti"), cat.phases.join(ids.withColumnRenamed("id", "event_id"), "event_id", "left_anti"))


def remove_first_phase(phases: DataFrame, wanted: DataFrame, order: str) -> DataFrame:
    """Without the first phase of each (event_id, station_id, type) of ``wanted``."""
    keys = ["event_id", "station_id", "type"]
    rows = phases.join(wanted.select(*keys).distinct().withColumn("_w", F.lit(1)), keys, "left")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return rows.where("_w is null or _k > 1").drop("_w", "_k")


def extract_events(cat: Catalog, ids: DataFrame) -> Catalog:
    """Some events (id), their phases, and the stations of those."""
    phases = cat.phases.join(ids.withColumnRenamed("id", "event_id"), "event_id", "left_semi")
    stations = cat.stations.join(phases.select(F.col("station_id").alias("id")), "id", "left_semi")
    return Catalog(stations, cat.events.join(ids, "id", "left_semi"), phases)


def with_processing(cat: Catalog, p_phases: list[str], s_phases: list[str], classes: list[float], source: str = "CATALOG") -> DataFrame:
    """Phases of known events, with group (P, S or NO), class_weight and source."""
    known = cat.phases.join(cat.events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return known.withColumns({"group": phase_group(F.col("type"), p_phases, s_phases), "class_weight": pick_weight(F.col("lower_unc"), F.col("upper_unc"), classes), "source": F.lit(source)})


def orphans(cat: Catalog) -> DataFrame:
    """Phases whose event or station the catalog lacks."""
    no_event = cat.phases.join(cat.events.select(F.col("id").alias("event_id")), "event_id", "left_anti").withColumn("missing", F.lit("event"))
    no_station = cat.phases.join(cat.stations.select(F.col("id").alias("station_id")), "station_id", "left_anti").withColumn("missing", F.lit("station"))
    return no_event.unionByName(no_station)


def first_phases(phases: DataFrame, order: list[str]) -> DataFrame:
    """One phase of each event, station and type: the first in an order."""
    w = Window.partitionBy("event_id", "station_id", "type").orderBy(*order)
    return phases.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def admitted(origins: DataFrame, automatic: bool = True, manual: bool = True, authors: list[str] | None = None, blocked_agencies: list | None = None) -> DataFrame:
    """Origins that a profile takes."""
    ok = ((F.col("mode") == "manual") & manual) | ((F.col("mode") != "manual") & automatic)
    if authors:
        ok &= F.col("author").isin(authors)
    if blocked_agencies:
        ok &= F.col("agency").isNull() | ~F.col("agency").isin(blocked_agencies)
    return origins.where(ok)
