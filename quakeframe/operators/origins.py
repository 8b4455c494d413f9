"""Origins and events as archives have them: lookups by id, parents, lists, admission by status, and what a map shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ids(ids: DataFrame, origins: DataFrame, key: str = "origin") -> tuple[DataFrame, DataFrame]:
    """The origins (public_id, ...) that a list names, each once, and the names (``key``) that no origin has."""
    wanted = ids.select(F.col(key).alias("public_id")).distinct()
    return origins.join(wanted, "public_id", "left_semi"), wanted.join(origins.select("public_id"), "public_id", "left_anti").withColumnRenamed("public_id", key)


def with_parents(origins: DataFrame, references: DataFrame, events: DataFrame) -> DataFrame:
    """origins with event_id and the event's preferred magnitude: of several events that refer to an origin (event_id, origin_id, seq) the first
    reference counts; NULLs without one. events: event_id, preferred_magnitude."""
    first = references.groupBy("origin_id").agg(F.min_by("event_id", "seq").alias("event_id"))
    return origins.join(first.withColumnRenamed("origin_id", "public_id"), "public_id", "left").join(events.select("event_id", "preferred_magnitude"), "event_id", "left").select(*origins.columns, "event_id", "preferred_magnitude")


def status_filter(column: Column, included: list[str] | None = None, excluded: list[str] | None = None) -> Column:
    """Lists of words in any case: with ``included`` only those pass, and no NULL; ``excluded`` ones don't, NULL does."""
    ok = F.lit(True)
    if included:
        ok &= F.coalesce(F.lower(column).isin([x.lower() for x in included]), F.lit(False))
    if excluded:
        ok &= ~F.coalesce(F.lower(column).isin([x.lower() for x in excluded]), F.lit(False))
    return ok


def listed(events: DataFrame, origins: DataFrame, start_us: int, end_us: int, types: list[str] | None = None, least_phases: int = 0, modified_after_us: int | None = None) -> DataFrame:
    """Origins (event_id, t_us, n_phases, ...) of events (event_id, type) in a span of time [start, end), which a table that is partitioned by time prunes.
    An empty word in ``types`` stands for events without a type."""
    rows = origins.where((F.col("t_us") >= start_us) & (F.col("t_us") < end_us))
    if least_phases > 0:
        rows = rows.where(F.col("n_phases") >= least_phases)
    if modified_after_us is not None:
        rows = rows.where(F.col("modified_us") > modified_after_us)
    if types is not None:
        events = events.where(F.coalesce(F.col("type"), F.lit("")).isin(types))
    return rows.join(events.select("event_id", "type"), "event_id")


def renamed(phases: DataFrame, manual: Column, p_name: str = "", s_name: str = "") -> DataFrame:
    """Phases of origins that aren't manual with the names that the background catalog has for P and S; an empty name changes nothing."""
    new = F.col("type")
    for old, name in (("P", p_name), ("S", s_name)):
        if name:
            new = F.when((F.col("type") == old) & ~manual, name).otherwise(new)
    return phases.withColumn("type", new)


def uncertainty(pick_lower: Column, pick_upper: Column, symmetric: Column) -> tuple[Column, Column]:
    """Lower and upper uncertainty of a pick: the symmetric one, else its own two if it has both, else NULL."""
    both = pick_lower.isNotNull() & pick_upper.isNotNull()
    return tuple(F.coalesce(symmetric, F.when(both, c)) for c in (pick_lower, pick_upper))


def same_events(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, wanted_id) of events with equal content (time, place and magnitude); NULLs are equal."""
    content = ["t_us", "latitude", "longitude", "depth", "magnitude"]
    b = wanted.select(F.col("id").alias("wanted_id"), *[F.col(c).alias(f"_{c}") for c in content])
    match = F.lit(True)
    for c in content:
        match &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return events.join(b, match).select("id", "wanted_id")


def shown(rows: DataFrame, start_us: int | None = None, end_us: int | None = None, south: float = -90.0, north: float = 90.0, west: float = -180.0, east: float = 180.0) -> DataFrame:
    """What a map draws: times between both ends, which count and may be open, in a view that may cross the date line."""
    rows = rows.where(F.col("t_us") >= start_us) if start_us is not None else rows
    rows = rows.where(F.col("t_us") <= end_us) if end_us is not None else rows
    lon = F.col("longitude").between(west, east) if west <= east else (F.col("longitude") >= west) | (F.col("longitude") <= east)
    return rows.where(F.col("latitude").between(south, north) & lon)


def links(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines of a map from where events were to where they are: id and both places."""
    place = ["latitude", "longitude", "depth"]
    return before.select("id", *[F.col(c).alias(f"{c}1") for c in place]).join(after.select("id", *[F.col(c).alias(f"{c}2") for c in place]), "id")


def deduplicated(origins: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first origin of each key, as a store of processed ids keeps it."""
    w = Window.partitionBy(*keys).orderBy(order)
    return origins.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def waveform_counts(picks: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """By station: picks whose waveform was found, is unavailable, or was asked for again (it counts once as found, the others come from memory)."""
    asked = picks.groupBy("station_id", *keys).agg(F.count("*").alias("n"))
    rows = asked.join(found.select("station_id", *keys).distinct().withColumn("_f", F.lit(1)), ["station_id", *keys], "left")
    return rows.groupBy("station_id").agg(F.count("_f").alias("found"), F.count_if(F.col("_f").isNull()).alias("unavailable"), F.sum(F.when(F.col("_f") == 1, F.col("n") - 1).otherwise(0)).alias("cached"))
