"""Catalogs as CSV files: stations, events and phases, pairs of neighbours, cross-correlations.

Columns go by their names in the header; others are ignored, optional ones may be missing. Values that can't be read raise an error that
names the file and the value; empty optional ones are NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import format_iso, parse_iso
from ..schema import Catalog


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, "" for missing ends of rows, and ``_row``, a number that grows along the file."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns]).withColumn("_row", F.monotonically_increasing_id())


def _required(name: str, kind: str, path: str) -> Column:
    got = F.expr(f"try_cast(trim({name}) as {kind})")
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit(f"{path}: {name}: "), F.col(name))).cast(kind))


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.expr(f"try_cast(trim({name}) as {kind})") if name in df.columns else F.lit(None).cast(kind)


def _flag(df: DataFrame, name: str) -> Column:
    return F.col(name).isin("1", "true", "True", "TRUE") if name in df.columns else F.lit(False)


def _time(name: str, path: str) -> Column:
    got = parse_iso(F.trim(F.col(name)))
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit(f"{path}: {name}: "), F.col(name))).cast("bigint"))


def station_id(network: Column, station: Column, location: Column) -> Column:
    return F.concat_ws(".", network, station, F.coalesce(location, F.lit("")))


def _last(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_row")))).where("_k = 1").drop("_k", "_row")


def read_catalog(spark: SparkSession, stations: str, events: str, phases: str) -> Catalog:
    """The three files; of repeated station and event ids the last row counts. Phases of unknown stations raise an error; those of
    unknown events stay."""
    s = read_csv(spark, stations)
    codes = [F.col(c) for c in ("networkCode", "stationCode", "locationCode")]
    st = _last(s.select(station_id(*codes).alias("id"), *[_required(c, "double", stations).alias(c) for c in ("latitude", "longitude", "elevation")], codes[0].alias("network"), codes[1].alias("station"), codes[2].alias("location"), "_row"), "id")
    e = read_csv(spark, events)
    ev = _last(
        e.select(
            _required("id", "bigint", events).alias("id"), _time("isotime", events).alias("t_us"), *[_required(c, "double", events).alias(c) for c in ("latitude", "longitude", "depth")],
            _optional(e, "magnitude", "double").alias("magnitude"), _flag(e, "relocated").alias("relocated"), _optional(e, "startRms", "double").alias("start_rms"), _optional(e, "finalRms", "double").alias("final_rms"), "_row",
        ),
        "id",
    )
    p = read_csv(spark, phases)
    ph = p.select(
        _required("eventId", "bigint", phases).alias("event_id"), station_id(*codes).alias("station_id"), _time("isotime", phases).alias("t_us"),
        _optional(p, "lowerUncertainty", "double").alias("lower_unc"), _optional(p, "upperUncertainty", "double").alias("upper_unc"), F.col("type"),
        codes[0].alias("network"), codes[1].alias("station"), codes[2].alias("location"), F.col("channelCode").alias("channel"), _flag(p, "usedInReloc").alias("relocated"),
        _optional(p, "weight", "double").alias("weight"), _optional(p, "startResidual", "double").alias("start_residual"), _optional(p, "finalResidual", "double").alias("final_residual"),
    )
    known = ph.join(st.select(F.col("id").alias("station_id"), F.lit(True).alias("_there")), "station_id", "left")
    ph = known.withColumn("station_id", F.when(F.col("_there"), F.col("station_id")).otherwise(F.raise_error(F.concat(F.lit(f"{phases}: no station "), F.col("station_id"))).cast("string"))).drop("_there")
    return Catalog(st, ev, ph.select("event_id", *[c for c in ph.columns if c != "event_id"]))


def number(c: Column, digits: int) -> Column:
    return F.when(c.isNull(), "").otherwise(F.format_string(f"%.{digits}f", c))


def write_catalog(cat: Catalog, stations: str, events: str, phases: str) -> None:
    """Folders of CSV, ordered by id over all their files; columns of relocations only if an event is relocated."""
    s = cat.stations.orderBy("id")
    _write(s.select(number(F.col("latitude"), 8).alias("latitude"), number(F.col("longitude"), 8).alias("longitude"), number(F.col("elevation"), 3).alias("elevation"), F.col("network").alias("networkCode"), F.col("station").alias("stationCode"), F.col("location").alias("locationCode")), stations)
    moved = "relocated" in cat.events.columns and not cat.events.where("relocated").limit(1).isEmpty()
    cols = ["id", format_iso(F.col("t_us")).alias("isotime"), *[number(F.col(c), d).alias(c) for c, d in (("latitude", 8), ("longitude", 8), ("depth", 6), ("magnitude", 3))]]
    if moved:
        cols += [F.col("relocated").cast("string").alias("relocated"), F.coalesce(F.col("start_rms").cast("string"), F.lit("")).alias("startRms"), F.coalesce(F.col("final_rms").cast("string"), F.lit("")).alias("finalRms")]
    _write(cat.events.orderBy("id").select(*cols), events)
    cols = [F.col("event_id").alias("eventId"), format_iso(F.col("t_us")).alias("isotime"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (("lower_unc", "lowerUncertainty"), ("upper_unc", "upperUncertainty"))], "type", F.col("network").alias("networkCode"), F.col("station").alias("stationCode"), F.col("location").alias("locationCode"), F.col("channel").alias("channelCode")]
    if moved and "weight" in cat.phases.columns:
        cols += [F.col("relocated").cast("string").alias("usedInReloc"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (("weight", "weight"), ("start_residual", "startResidual"), ("final_residual", "finalResidual"))]]
    _write(cat.phases.orderBy("event_id", "station_id", "type").select(*cols), phases)


def _write(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


PAIR = ("eventId1", "eventId2", "networkCode", "stationCode", "locationCode", "phaseType")


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a file of neighbour pairs; both ends of a pair are nodes."""
    df = read_csv(spark, path)
    edges = df.select(_required("eventId1", "bigint", path).alias("ref_id"), _required("eventId2", "bigint", path).alias("neigh_id"), F.col("phaseType").alias("type"), station_id(*map(F.col, PAIR[2:5])).alias("station_id"))
    return edges, edges.select(F.col("ref_id").alias("id")).union(edges.select("neigh_id")).distinct()


def write_pairs(edges: DataFrame, stations: DataFrame, path: str) -> None:
    rows = edges.join(stations.select(F.col("id").alias("station_id"), "network", "station", "location"), "station_id")
    _write(rows.select(*[F.col(c).alias(n) for c, n in zip(("ref_id", "neigh_id", "network", "station", "location", "type"), PAIR, strict=True)]), path)


def read_xcorr(spark: SparkSession, path: str) -> DataFrame:
    """Cross-correlations of a file, least event first; of repeated pairs, in either direction, the last row counts."""
    from ..operators.joins import canonical_xcorr

    df = read_csv(spark, path)
    rows = df.select(_required("eventId1", "bigint", path).alias("ev1"), _required("eventId2", "bigint", path).alias("ev2"), station_id(*map(F.col, PAIR[2:5])).alias("station_id"), F.col("phaseType").alias("type"), _flag(df, "valid").alias("valid"), _optional(df, "coefficient", "double").alias("coefficient"), _optional(df, "lag", "double").alias("lag"), "_row")
    return canonical_xcorr(rows, "_row").drop("_row")


def origins_to_catalog(origins: DataFrame, arrivals: DataFrame, picks: DataFrame, sensors: DataFrame, references: DataFrame | None = None, events: DataFrame | None = None) -> Catalog:
    """Events and phases of origins (public_id, t_us, latitude, longitude, depth, magnitude) with arrivals (origin_id, pick_id, phase, weight,
    time_used), picks (public_id, t_us, mode, network, station, location, channel, lower_unc, upper_unc) and sensors (network, station, location,
    start_us, end_us, latitude, longitude, elevation).

    With references (event_id, origin_id, seq) and events (event_id, preferred_magnitude) an origin's magnitude is that which the event it belongs to
    prefers; its own counts where there is none. Origins without arrivals go, as do arrivals without a pick or a sensor at its time, and picks that aren't manual with weight 0 or unused."""
    from ..operators.joins import valid_at
    from ..operators.origins import with_parents
    from ..operators.stats import ranked

    if references is not None:
        own = origins.columns if "magnitude" in origins.columns else [*origins.columns, "magnitude"]
        origins = origins if "magnitude" in origins.columns else origins.withColumn("magnitude", F.lit(None).cast("double"))
        origins = with_parents(origins, references, events).withColumn("magnitude", F.coalesce("preferred_magnitude", "magnitude")).select(own)
    rows = arrivals.join(picks.withColumnRenamed("public_id", "pick_id"), "pick_id").where("mode = 'manual' or (weight > 0 and time_used)")
    spans = sensors.select("network", "station", "location", "start_us", "end_us", F.col("latitude").alias("st_lat"), F.col("longitude").alias("st_lon"), F.col("elevation").alias("st_elev"))
    rows = valid_at(rows, spans, ["network", "station", "location"], "t_us").where("st_lat is not null")
    kept = origins.join(arrivals.select(F.col("origin_id").alias("public_id")), "public_id", "left_semi")
    ids = ranked(kept.select("public_id"), ["public_id"]).select("public_id", F.col("_rank").cast("bigint").alias("id"))
    events = kept.join(ids, "public_id").select("id", "t_us", "latitude", "longitude", "depth", "magnitude")
    sid = station_id(F.col("network"), F.col("station"), F.col("location"))
    phases = rows.join(ids.withColumnRenamed("public_id", "origin_id"), "origin_id").select(F.col("id").alias("event_id"), sid.alias("station_id"), "t_us", "lower_unc", "upper_unc", F.col("phase").alias("type"), "network", "station", "location", "channel")
    stations = rows.groupBy(sid.alias("id")).agg(*[F.max_by(c, "start_us").alias(n) for c, n in (("st_lat", "latitude"), ("st_lon", "longitude"), ("st_elev", "elevation"), ("network", "network"), ("station", "station"), ("location", "location"))])
    return Catalog(stations, events, phases)


def write_xcorr(cache: DataFrame, stations: DataFrame, path: str) -> None:
    """A cache of lags (ev1, ev2, station_id, type, valid, coefficient, lag) as ``read_xcorr`` reads it."""
    rows = cache.join(stations.select(F.col("id").alias("station_id"), "network", "station", "location"), "station_id")
    cols = [F.col(c).alias(n) for c, n in zip(("ev1", "ev2", "network", "station", "location", "type"), PAIR, strict=True)]
    _write(rows.select(*cols, F.col("valid").cast("string").alias("valid"), *[number(F.col(c), 6).alias(c) for c in ("coefficient", "lag")]), path)


def write_differences(rows: DataFrame, stations: DataFrame, path: str) -> None:
    """Double differences as ``relocate.DIFFERENCES`` has them."""
    rows = rows.join(stations.select(F.col("id").alias("station_id"), "network", "station", "location"), "station_id")
    cols = [F.col(c).alias(n) for c, n in zip(("ref_id", "neigh_id", "network", "station", "location", "type"), PAIR, strict=True)]
    numbers = [number(F.col(c), d).alias(n) for c, n, d in (("weight", "weight", 6), ("coefficient", "coefficient", 6), ("residual", "doubleDifferenceResidual", 6), ("distance", "interEventDistance", 6))]
    _write(rows.select(*cols, numbers[0], F.col("xcorr_used").cast("string").alias("xcorrUsed"), *numbers[1:]), path)


def write_clusters(cat: Catalog, edges: DataFrame, named: DataFrame, path: str) -> None:
    """Pairs, events and phases of all clusters, in folders by cluster: edges with cluster_id, and (id, cluster_id) of the events."""
    pairs = edges.join(cat.stations.select(F.col("id").alias("station_id"), "network", "station", "location"), "station_id")
    pairs = pairs.select("cluster_id", *[F.col(c).alias(n) for c, n in zip(("ref_id", "neigh_id", "network", "station", "location", "type"), PAIR, strict=True)])
    tables = {"pairs": pairs, "events": cat.events.join(named, "id"), "phases": cat.phases.join(named.withColumnRenamed("id", "event_id"), "event_id")}
    for name, df in tables.items():
        df.repartition("cluster_id").write.partitionBy("cluster_id").option("header", True).csv(f"{path}/{name}")


def read_with_header(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A CSV file without a header line, whose columns have these names."""
    return spark.read.option("quote", '"').option("escape", '"').csv(path).toDF(*names)


#: The columns of a list of origins, and where they come from.
ORIGIN_LIST = (
    ("origin", "public_id"), ("event", "event_id"), ("eventType", "type"), ("evalMode", "mode"), ("evalStat", "status"), ("agencyID", "agency"), ("author", "author"), ("methodID", "method"), ("RMS", "rms"),
    ("numPhases", "n_phases"), ("latitude", "latitude"), ("longitude", "longitude"), ("depth", "depth"), ("time", "t_us"), ("creationTime", "created_us"), ("modificationTime", "modified_us"),
)


def write_origin_list(rows: DataFrame, path: str, simple: bool = False) -> None:
    """Origins with their events in the sixteen columns of the list, or ``simple``, their ids alone without a header. Columns that rows don't have are empty."""
    if simple:
        rows.select("public_id").write.mode("overwrite").option("header", False).csv(path)
        return
    known = {c: format_iso(F.col(c)) if c.endswith("_us") else F.col(c).cast("string") for c in rows.columns}
    rows = rows.select(*[F.coalesce(known.get(c, F.lit(None).cast("string")), F.lit("")).alias(n) for n, c in ORIGIN_LIST])
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
