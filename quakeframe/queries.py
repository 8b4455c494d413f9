"""One query for each operator, over the catalog tables of ``sources.lens``. Decimals are rounded to six places, so that engines agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, times
from .functions.weights import band_and_instrument, orientation
from .operators import records as record_ops
from .operators import catalog, graph, grids, joins, neighbours, origins, spatial, stats, system, travel_time, waveform
from .plans import relocate
from .schema import Catalog
from .sources.lens import Lens
from .sql_functions import register
from .streaming import realtime
from .tables import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

P, S = ["P", "Pg"], ["Sg"]
CLASSES = [0.0, 0.05, 0.1, 0.2, 0.3]
SELECTION = neighbours.Selection(max_km=5.0, min_neighbours=4, max_neighbours=10, min_phases=4)
TTT = travel_time.homogeneous(5.8, 3.4)


def query(f: Callable[[Lens], DataFrame]) -> Callable[[Lens], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Lens(spark, sf_dir))
    return f


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def cat1(x: Lens) -> Catalog:
    return Catalog(x.stations, x.events, x.phases)


def cat2(x: Lens) -> Catalog:
    """Catalog 2 with ids of which the lower half are those of catalog 1."""
    ev = x.events2.withColumn("id", (F.col("id") - 1000000) * 2)
    ph = x.phases.where("event_id % 11 <> 0").withColumn("event_id", F.col("event_id") * 2)
    return Catalog(x.stations, ev, ph)


def picks(x: Lens) -> DataFrame:
    return catalog.with_processing(cat1(x), P, S, CLASSES)


def timed(x: Lens) -> DataFrame:
    return travel_time.with_travel_times(picks(x), x.events, x.stations, TTT)


def few(df: DataFrame, column: str = "id") -> DataFrame:
    return df.where(F.col(column) % 3 == 0).select(F.col(column).alias("id")).distinct()


# catalogs


@query
def catalog_load(x: Lens) -> DataFrame:
    n = x.phases.groupBy("event_id").agg(F.count("*").alias("n_phases"), F.count_distinct("station_id").alias("n_stations"))
    return x.events.join(n.withColumnRenamed("event_id", "id"), "id", "left").select("id", "t_us", r6("latitude").alias("latitude"), r6("depth").alias("depth"), F.coalesce("n_phases", F.lit(0)).alias("n_phases"), F.coalesce("n_stations", F.lit(0)).alias("n_stations"))


def _summed(c: Catalog) -> DataFrame:
    n = c.phases.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("n_phases"), F.sum("t_us").alias("sum_us"))
    return c.events.join(n, "id", "left").select("id", "t_us", r6("depth").alias("depth"), F.coalesce("n_phases", F.lit(0)).alias("n_phases"), F.coalesce("sum_us", F.lit(0)).alias("sum_us"))


@query
def catalog_merge_keepid(x: Lens) -> DataFrame:
    return _summed(catalog.merge_keep_ids(cat1(x), cat2(x)))


@query
def catalog_merge_renumber(x: Lens) -> DataFrame:
    return _summed(catalog.merge_renumbered(cat1(x), cat2(x)))


@query
def upsert_event(x: Lens) -> DataFrame:
    return catalog.upsert(x.events, cat2(x).events, add_missing=False).select("id", "t_us", r6("depth").alias("depth"))


@query
def remove_event_cascade(x: Lens) -> DataFrame:
    return _summed(catalog.remove_events(cat1(x), few(x.events)))


@query
def extract_event(x: Lens) -> DataFrame:
    c = catalog.extract_events(cat1(x), few(x.events))
    return c.stations.join(c.phases.groupBy(F.col("station_id").alias("id")).agg(F.count("*").alias("n")), "id").select("id", "n")


@query
def orphan_phases(x: Lens) -> DataFrame:
    c = Catalog(x.stations.where("number % 5 <> 0"), x.events.where("id % 7 <> 0"), x.phases)
    return catalog.orphans(c).groupBy("missing", "type").agg(F.count("*").alias("n"))


@query
def remove_phase(x: Lens) -> DataFrame:
    wanted = x.phases.where("event_id % 5 = 0 and type = 'P'")
    return catalog.remove_first_phase(x.phases, wanted, "t_us").groupBy("type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# predicates and projections


@query
def phase_class_weight(x: Lens) -> DataFrame:
    return picks(x).groupBy("group", "class_weight").agg(F.count("*").alias("n"), F.sum(F.col("t_us") % 1_000_000).alias("sum_us"))


@query
def region_rect(x: Lens) -> DataFrame:
    return x.events.select("id", geo.in_rectangle(F.col("latitude"), F.col("longitude"), 46.6, 46.9, 8.2, 8.6).cast("int").alias("plain"), geo.in_rectangle(F.col("latitude"), F.col("longitude"), 46.6, 46.9, 8.5, 8.1).cast("int").alias("wrapped"))


@query
def region_circle(x: Lens) -> DataFrame:
    return x.events.where(geo.in_circle(F.col("latitude"), F.col("longitude"), 46.8, 8.4, 12.5)).select("id")


@query
def origin_filters(x: Lens) -> DataFrame:
    rows = catalog.admitted(x.origins, automatic=True, authors=["click", "view", "error"], blocked_agencies=[3, 5])
    return rows.groupBy("author", "mode").agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


@query
def iso_time(x: Lens) -> DataFrame:
    text = times.format_iso(F.col("t_us") + (F.col("id") % 5) * 123456)
    return x.events.select("id", text.alias("iso"), times.parse_iso(text).alias("back"))


@query
def time_windows(x: Lens) -> DataFrame:
    w1 = times.window(F.col("t_us"), F.col("t_us") + 60_000_000)
    w2 = times.window(F.col("t_us") + (F.col("id") % 9) * 10_000_000, F.col("t_us") + (F.col("id") % 9) * 10_000_000 + 20_000_000)
    common = times.overlap(w1, w2)
    return x.events.select("id", common["start"].alias("start"), common["end"].alias("end"), times.length(times.merged(w1, w2)).alias("both"), times.contains(w1, w2["end"]).cast("int").alias("inside"))


# geometry


@query
def azimuth(x: Lens) -> DataFrame:
    """Each event with each station that has a pick of it."""
    b = x.stations.select(F.col("id").alias("station_id"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    seen = x.phases.select(F.col("event_id").alias("id"), "station_id").distinct()
    rows = seen.join(x.events, "id").join(b, "station_id")
    args = [F.col(c) for c in ("latitude", "longitude", "lat2", "lon2")]
    return rows.select("id", "station_id", r6(geo.normalize_azimuth(F.degrees(geo.azimuth(*args)))).alias("azimuth"), r6(geo.distance(*args, F.col("depth"))).alias("km"))


@query
def direct_geodesic(x: Lens) -> DataFrame:
    lat, lon = geo.move(F.col("latitude"), F.col("longitude"), (F.col("id") % 50).cast("double"), F.radians((F.col("id") % 360).cast("double")), F.col("depth"))
    return x.events.select("id", r6(lat).alias("lat"), r6(lon).alias("lon"))


@query
def trilinear(x: Lens) -> DataFrame:
    f = [(F.col("id") * k % 97).cast("double") / 97.0 for k in (3, 5, 7)]
    v = [(F.col("id") * (k + 11) % 101).cast("double") for k in range(8)]
    return x.events.select("id", r6(geo.trilinear(*f, v)).alias("value"), r6(geo.bilinear(f[0], f[1], *v[:4])).alias("flat"), F.round(geo.bilinear_angle(f[0], f[1], *[c + 40 for c in v[:4]]), 4).alias("degrees"))


@query
def map_projections(x: Lens) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    xy = {"flat": geo.to_flat(lat, lon, 46.8, 8.4, 30.0), "tm": geo.transverse_mercator(lat, lon, 46.8, 8.4), "lcc": geo.lambert(lat, lon, 46.8, 8.4, 46.0, 47.5), "aeqd": geo.azimuthal_equidistant(lat, lon, 46.8, 8.4), "sdc": geo.short_distance(lat, lon, 46.8, 8.4, 30.0)}
    # inverses go back by steps from columns: from expressions each step would work the projection out again; a small file is one task, so rows are dealt
    rows = x.events.select("id", *[c.alias(f"{n}_{k}") for n, p in xy.items() for k, c in zip("xy", p, strict=True)]).repartition("id")
    xy = {n: (F.col(f"{n}_x"), F.col(f"{n}_y")) for n in xy}
    back = geo.from_flat(*xy["flat"], 46.8, 8.4, 30.0)
    others = {"tm": geo.from_transverse_mercator(*xy["tm"], 46.8, 8.4), "lcc": geo.from_lambert(*xy["lcc"], 46.8, 8.4, 46.0, 47.5), "aeqd": geo.from_azimuthal_equidistant(*xy["aeqd"], 46.8, 8.4), "sdc": geo.from_short_distance(*xy["sdc"], 46.8, 8.4, 30.0)}
    inverses = [r6(c).alias(f"{n}_{k}") for n, p in others.items() for k, c in zip(("lat", "lon"), p, strict=True)]
    return rows.select("id", *inverses, *[r6(c).alias(f"{n}_{k}") for n, p in xy.items() for k, c in zip("xy", p, strict=True)], r6(back[0]).alias("lat"), r6(back[1]).alias("lon"))


# archives and maps


@query
def origin_list(x: Lens) -> DataFrame:
    ids = x.origins.select(F.explode(F.array("seq", F.col("seq") + 1_000_000_000)).alias("origin")).where("origin % 3 = 0")
    found, missing = origins.by_ids(ids, x.origins.withColumnRenamed("seq", "public_id"))
    rows = found.select(F.lit("found").alias("kind"), F.col("public_id").alias("origin")).unionByName(missing.select(F.lit("missing").alias("kind"), "origin"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("origin").alias("ids"))


@query
def parent_event(x: Lens) -> DataFrame:
    refs = x.origins.select("event_id", (F.col("seq") - F.col("seq") % 2).alias("origin_id"), "seq")
    ev = x.events.select(F.col("id").alias("event_id"), F.col("magnitude").alias("preferred_magnitude"))
    found = origins.with_parents(x.origins.select(F.col("seq").alias("public_id"), "author"), refs, ev)
    return found.select("public_id", "event_id", r6("preferred_magnitude").alias("preferred_magnitude"))


@query
def event_list(x: Lens) -> DataFrame:
    ev = x.events.select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("type"), (F.col("id") % 5).cast("string"))).alias("type"))
    rows = x.origins.withColumns({"t_us": F.col("created_s") * 1_000_000, "modified_us": F.col("seq"), "status": F.when(F.col("seq") % 4 > 0, F.concat(F.lit("St"), (F.col("seq") % 4).cast("string")))})
    rows = rows.where(origins.status_filter(F.col("status"), excluded=["sT2"]) & origins.status_filter(F.col("author"), included=["CLICK", "view"]))
    found = origins.listed(ev, rows, 10_000_000_000, 80_000_000_000, ["", "type2", "type3"], 4, 100)
    return found.groupBy("type", "status").agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


@query
def phase_type_map(x: Lens) -> DataFrame:
    found = origins.renamed(x.phases, F.col("event_id") % 4 == 0, "Pn", "Sn")
    return found.groupBy("type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query
def channel_codes(x: Lens) -> DataFrame:
    code = F.expr("substring('HHZ1', 1, cast(event_id % 5 as int))")
    return x.phases.select(code.alias("channel")).distinct().select("channel", band_and_instrument(F.col("channel")).alias("band"), orientation(F.col("channel")).alias("component"))


@query
def pick_uncertainty(x: Lens) -> DataFrame:
    lower, upper = (F.when(F.col("event_id") % k > 0, F.col(c)) for k, c in ((3, "lower_unc"), (4, "upper_unc")))
    lo, up = origins.uncertainty(lower, upper, F.when(F.col("event_id") % 5 == 0, F.lit(0.25)))
    return x.phases.groupBy("type").agg(F.count(lo).alias("n"), r6(F.sum(lo)).alias("lower"), r6(F.sum(up)).alias("upper"))


@query
def same_event(x: Lens) -> DataFrame:
    return origins.same_events(x.events, x.events2.withColumns({"t_us": F.col("t_us") + 300_000 - (F.col("id") - 1_000_000) % 7 * 100_000, "depth": F.col("depth") - 0.5}))


@query
def origin_dedup(x: Lens) -> DataFrame:
    return origins.deduplicated(x.origins, ["event_id", "created_s"], "seq").groupBy("event_id").agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


@query
def map_view(x: Lens) -> DataFrame:
    rows = origins.shown(x.events, 1577836800000000 + 61_000_000 * 20, None, 46.6, 47.0, 8.1, 8.6)
    over = origins.shown(x.events, None, 1577836800000000 + 61_000_000 * 900, west=8.5, east=8.2)
    return rows.select(F.lit("inside").alias("view"), "id").unionByName(over.select(F.lit("around").alias("view"), "id"))


@query
def map_links(x: Lens) -> DataFrame:
    found = origins.links(x.events, x.events2.withColumn("id", F.col("id") - 1_000_000))
    return found.select("id", *[r6(f"{c}{k}").alias(f"{c}{k}") for k in (1, 2) for c in ("latitude", "longitude", "depth")])


@query
def grid_nearest(x: Lens) -> DataFrame:
    sources = x.events.select("id", "latitude", "longitude", F.lit(0.0).alias("depth"))
    st = x.stations.select(F.col("number").alias("id"), "latitude", "longitude", F.lit(0.0).alias("depth"))
    return spatial.nearest_grid(st, sources, 4000.0).select("station_id", "grid_id", r6("distance").alias("distance"))


def lens_grids(x: Lens) -> grids.GridTables:
    """Grids of straight rays for all stations but each seventh: 3-D for P, over distance and depth for S, of 7 by 7 by 4 and 9 by 4 nodes."""
    st = x.stations.where("number % 7 <> 0")
    form = "30e0 AS dx, 15e0 AS dy, 5e0 AS dz, 46.8e0 AS lat0, 8.4e0 AS lon0, 20e0 AS rotation"
    of = lambda kind, group, k: f"number * 10 + {k} AS grid_id, '{kind}' AS kind, '{group}' AS `group`"
    source = "latitude AS source_latitude, longitude AS source_longitude, -elevation / 1e3 AS source_depth, 'km/s' AS unit"
    deep = "true AS three_d, 4L AS nx, 7L AS ny, 4L AS nz, -45e0 AS x0, -45e0 AS y0, 0e0 AS z0, " + form
    flat = "false AS three_d, 1L AS nx, 7L AS ny, 4L AS nz, 0e0 AS x0, 0e0 AS y0, 0e0 AS z0, " + form
    headers = None
    for k, (kind, group, shape) in enumerate([("time", "P", deep), ("angle", "P", deep), ("time", "S", flat), ("angle", "S", flat)]):
        own = st.selectExpr(*of(kind, group, k).split(", "), *shape.split(", "), *source.split(", "))
        headers = own if headers is None else headers.unionByName(own)
    one = x.spark.range(1).selectExpr("id", "46.8e0 AS latitude", "8.4e0 AS longitude", "0e0 AS elevation")
    for k, (group, shape) in enumerate([("P", deep), ("S", flat)]):
        headers = headers.unionByName(one.selectExpr(f"-1L - {k} AS grid_id", "'velocity' AS kind", f"'{group}' AS `group`", *shape.split(", "), *source.split(", ")))
    nodes = headers.withColumns({f"i{n}": F.explode(F.sequence(F.lit(0), F.col(f"n{n}") - 1)) for n in "x"})
    for n in "yz":
        nodes = nodes.withColumn(f"i{n}", F.explode(F.sequence(F.lit(0), F.col(f"n{n}") - 1)))
    sx, sy = geo.to_flat(F.col("source_latitude"), F.col("source_longitude"), F.col("lat0"), F.col("lon0"), F.col("rotation"))
    px, py, pz = (F.col(f"{n}0") + F.col(f"i{n}") * F.col(f"d{n}") for n in "xyz")
    along = F.when(F.col("three_d"), F.hypot(sx - px, sy - py)).otherwise(py)
    up, v = pz - F.col("source_depth"), F.when(F.col("group") == "P", 5.8).otherwise(3.4)
    value = F.when(F.col("kind") == "velocity", v + pz / 100).when(F.col("kind") == "time", F.sqrt(along * along + up * up) / v).otherwise(90 + F.degrees(F.atan2(up, along)))
    nodes = nodes.select("grid_id", "ix", "iy", "iz", value.alias("value"), F.when(F.col("three_d"), geo.normalize_azimuth(F.degrees(F.atan2(sx - px, sy - py)))).alias("azimuth"), F.lit(9).alias("quality"))
    headers = settled(headers)
    return grids.GridTables(headers, settled(grids.make_cells(headers, nodes)), settled(grids.assign(x.stations, headers, 10.0)))


@query
def tt_grid(x: Lens) -> DataFrame:
    ev = x.events.select(F.col("id").alias("event_id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col("depth").alias("_dep"))
    st = x.stations.select(F.col("id").alias("station_id"), F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"))
    rows = picks(x).select("event_id", "station_id", "type", "group").join(ev, "event_id").join(st, "station_id")
    found = lens_grids(x).compute(rows)
    return found.select("event_id", "station_id", "type", "found", *(r6(c).alias(c) for c in ("travel_time", "azimuth", "dip", "dtdd", "dtdh")))


@query
def waveform_counters(x: Lens) -> DataFrame:
    asked = x.phases.select("station_id", (F.col("t_us") - F.col("t_us") % 60_000_000).alias("start_us"))
    return origins.waveform_counts(asked, asked.where("start_us % 7 <> 0"), ["start_us"])


@query
def common_stations(x: Lens) -> DataFrame:
    """Stations with P and S picks, and those with P picks alone."""
    p, s = (x.phases.where(F.col("type").isin(t)).select("station_id", (F.col("event_id") % 50).alias("part")) for t in (P, S))
    return p.intersect(s).withColumn("kind", F.lit("both")).unionByName(p.subtract(s).withColumn("kind", F.lit("P"))).groupBy("kind", "part").agg(F.count("*").alias("n"))


# joins


@query
def radius_pairs(x: Lens) -> DataFrame:
    return spatial.neighbours_within(x.events, 5.0, digits=6)


@query
def knn_events(x: Lens) -> DataFrame:
    found = spatial.nearest(x.events, x.events, 5)
    return found.select("a_id", "b_id", F.col("rank").cast("bigint").alias("rank"), r6("distance").alias("distance"))


@query
def nearest_station(x: Lens) -> DataFrame:
    st = x.stations.select(F.col("number").alias("id"), "latitude", "longitude", geo.station_depth(F.col("elevation")).alias("depth"))
    return spatial.nearest(x.events, st, 1).select("a_id", "b_id", r6("distance").alias("distance"))


@query
def catalog_compare(x: Lens) -> DataFrame:
    a = x.events
    return joins.compare_catalogs(a, x.events2, 250_000).select("id", "status", "b_id", "time_us", F.round("epi_m", 3).alias("epi_m"), F.round("depth_m", 3).alias("depth_m"), F.round("hypo_m", 3).alias("hypo_m"))


def xcorr_rows(x: Lens) -> DataFrame:
    return x.spark.sql(
        "select seq, seq * 7 % 50 as ev1, seq * 13 % 50 + 50 * (seq % 2) as ev2, concat('S', seq % 4) as station_id, if(seq % 3 = 0, 'S', 'P') as type, seq % 5 <> 0 as valid, cast(seq % 199 - 99 as double) / 99e0 as coefficient, cast(seq % 21 - 10 as double) / 100e0 as lag from {o} where seq * 7 % 50 <> seq * 13 % 50 + 50 * (seq % 2)",
        o=x.origins,
    )


@query
def xcorr_symmetric_lookup(x: Lens) -> DataFrame:
    cache = joins.canonical_xcorr(xcorr_rows(x), "seq")
    edges = xcorr_rows(x).select(F.col("ev2").alias("ref_id"), F.col("ev1").alias("neigh_id"), "station_id", "type").distinct()
    return joins.lookup_xcorr(edges, cache).select("ref_id", "neigh_id", "station_id", "type", F.col("valid").cast("int").alias("valid"), (r6("coefficient") + 0.0).alias("coefficient"), (r6("lag") + 0.0).alias("lag"))


@query
def sensor_validity_join(x: Lens) -> DataFrame:
    spans = x.stations.select(F.col("id").alias("station_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("k"))
    spans = spans.select("station_id", (F.lit(1577836800000000) + F.col("k") * 30_000_000_000).alias("start_us"), F.when(F.col("k") < 3, F.lit(1577836800000000) + (F.col("k") + 1) * 30_000_000_000 + 1000).alias("end_us"), F.col("k").alias("epoch"))
    rows = x.phases.select("event_id", "station_id", "type", "t_us")
    return joins.valid_at(rows, spans, ["station_id"], "t_us").groupBy("station_id", "epoch").agg(F.count("*").alias("n"), F.max("t_us").alias("last_us"))


@query
def request_coalesce(x: Lens) -> DataFrame:
    req = x.phases.select("station_id", (F.col("t_us") - 20_000_000).alias("start_us"), (F.col("t_us") + 25_000_000).alias("end_us"))
    return joins.merge_requests(req, ["station_id"], 2_000_000)


@query
def containing_trace(x: Lens) -> DataFrame:
    traces = x.phases.select("station_id", (F.col("t_us") - 60_000_000).alias("trace_start_us"), (F.col("t_us") + 90_000_000).alias("trace_end_us"), F.col("event_id").alias("trace_id"))
    req = x.phases.select("station_id", (F.col("t_us") - 10_000_000).alias("start_us"), (F.col("t_us") + 10_000_000).alias("end_us")).distinct()
    return joins.containing_trace(req, traces, ["station_id"]).groupBy("station_id").agg(F.count("*").alias("n"), F.sum("trace_id").alias("ids"))


# neighbours and clusters


@query
def common_phases(x: Lens) -> DataFrame:
    return neighbours.eligible_edges(cat1(x), SELECTION).groupBy("ref_id", "neigh_id").agg(F.count("*").alias("n"), r6(F.sum("km")).alias("km"))


@query
def limited_phases(x: Lens) -> DataFrame:
    """Stations neither too near nor too far, far enough for their pair, and no more phases than the nearest six."""
    o = neighbours.Selection(max_km=5.0, min_phases=2, max_phases=6, min_station_km=8.0, max_station_km=60.0, min_ratio=3.0, strict_ref=True)
    return neighbours.eligible_edges(cat1(x), o).groupBy("ref_id", "neigh_id").agg(F.count("*").alias("n"), r6(F.sum("km")).alias("km"))


@query
def neighbour_catalog(x: Lens) -> DataFrame:
    edges = spatial.nearest_within(x.events, 5.0, 3)
    found = neighbours.to_catalog(edges, cat1(x), with_reference=False)
    return found.phases.groupBy("event_id").agg(F.count("*").alias("n"))


@query
def edge_order(x: Lens) -> DataFrame:
    edges = neighbours.eligible_edges(cat1(x), SELECTION).withColumn("distance", F.round("distance", 6))
    rows = neighbours.in_chunks(neighbours.in_order(edges), 4)
    return rows.groupBy("ref_id", "chunk").agg(F.count("*").alias("n"), F.sum("place").cast("bigint").alias("places")).withColumn("chunk", F.col("chunk").cast("bigint"))


@query
def neigh_peel(x: Lens) -> DataFrame:
    pairs = neighbours.eligible_edges(cat1(x), SELECTION).groupBy("ref_id", "neigh_id").agg(F.first("distance").alias("distance"))
    return neighbours.peel(pairs, 4, 10).groupBy("ref_id").agg(F.count("*").alias("n"))


@query
def neigh_nearest(x: Lens) -> DataFrame:
    return neighbours.select_neighbours(cat1(x), SELECTION).groupBy("ref_id", "neigh_id").agg(F.count("*").alias("n"), r6(F.first("distance")).alias("distance"))


@query
def neigh_ellipsoid(x: Lens) -> DataFrame:
    o = neighbours.Selection(max_km=5.0, max_neighbours=8, shells=3)
    return neighbours.shells_within(x.events, o).select("ref_id", "neigh_id", F.col("shell").cast("bigint").alias("shell"), F.col("octant").cast("bigint").alias("octant"))


@query
def neigh_shells(x: Lens) -> DataFrame:
    o = neighbours.Selection(max_km=5.0, min_neighbours=4, max_neighbours=8, min_phases=4, shells=3)
    return neighbours.select_neighbours(cat1(x), o).groupBy("ref_id", "neigh_id").agg(F.count("*").alias("n"))


@query
def clusters(x: Lens) -> DataFrame:
    return neighbours.clusters(neighbours.select_neighbours(cat1(x), SELECTION))[0]


@query
def pair_orientation(x: Lens) -> DataFrame:
    edges = spatial.nearest_within(x.events, 5.0, 6)
    return graph.oriented(edges).select("ref_id", "neigh_id")


# statistics


@query
def event_rms(x: Lens) -> DataFrame:
    rows = timed(x).select("event_id", "residual", F.col("class_weight").alias("weight"))
    return stats.event_rms(rows).select("event_id", "n", r6("rms").alias("rms"))


@query
def five_number(x: Lens) -> DataFrame:
    rows = x.phases.select("station_id", "type", F.col("lower_unc"))
    return stats.five_numbers(rows, ["station_id", "type"], "lower_unc")


@query
def median_mad(x: Lens) -> DataFrame:
    rows = x.phases.join(x.events.select(F.col("id").alias("event_id"), "depth"), "event_id")
    return stats.median_mad(rows, ["station_id"], "depth").select("station_id", "n", *[r6(c).alias(c) for c in ("median", "mad", "mean", "mean_deviation")])


@query
def circular_mean(x: Lens) -> DataFrame:
    return x.phases.groupBy("station_id").agg(r6(stats.circular_mean((F.col("event_id") % 360).cast("double"))).alias("direction"))


@query
def dist_binned_residuals(x: Lens) -> DataFrame:
    found = stats.binned_within(x.events, 5.0, "value", lambda ref, neigh: (ref * 31 + neigh * 17) % 1009, 1009, 20)
    return found.select("bin", "n", "min", "q1", "q2", "q3", "max", "from", "to")


@query
def xcorr_summary(x: Lens) -> DataFrame:
    rows = stats.xcorr_summary(xcorr_rows(x), 0.6)
    return rows.select("type", "station_id", "attempted", "failed", "good", *[r6(c).alias(c) for c in ("mean_coefficient", "failed_percent", "good_percent")])


@query
def origin_quality(x: Lens) -> DataFrame:
    rows = timed(x).withColumns({"used": F.col("class_weight") >= 0.25, "distance": F.col("travel_time") * 5.8})
    rows = stats.origin_quality(rows)
    return rows.select("event_id", "phases", "used_phases", "stations", "used_stations", *[r6(c).alias(c) for c in ("median_distance", "min_distance", "max_distance", "standard_error")])


@query
def azimuthal_gap(x: Lens) -> DataFrame:
    rows = timed(x).withColumn("az", F.round(geo.normalize_azimuth(F.col("azimuth")), 6))
    return stats.azimuthal_gap(rows, ["event_id"], "az").select("event_id", r6("gap").alias("gap"), r6("secondary_gap").alias("secondary_gap"))


@query
def rms_quantiles(x: Lens) -> DataFrame:
    rows = stats.event_rms(timed(x).select("event_id", "residual", F.col("class_weight").alias("weight"))).withColumn("rms", r6("rms"))
    q = stats.quantiles(rows, "rms", [i / 20 for i in range(21)])
    return q.select(F.col("k").cast("bigint").alias("k"), F.round("rms", 9).alias("rms"))  # nine places: halves of the sixth are common


@query
def equal_frequency(x: Lens) -> DataFrame:
    return stats.equal_frequency(x.events, "depth", 10).groupBy("bin").agg(F.count("*").alias("n"), F.min("depth").alias("low"), F.max("depth").alias("high")).select(F.col("bin").cast("bigint").alias("bin"), "n", r6("low").alias("low"), r6("high").alias("high"))


@query
def best_origin(x: Lens) -> DataFrame:
    rows = x.origins.withColumns({"created_us": F.col("created_s"), "rms": F.col("rms_milli")})
    out = None
    for rule in ("last", "first", "max-phases", "min-phases", "max-rms", "min-rms"):
        part = stats.best_origin(rows, rule).select(F.lit(rule).alias("rule"), "event_id", "seq")
        out = part if out is None else out.unionByName(part)
    return out


@query
def map_centroid(x: Lens) -> DataFrame:
    both = x.events.select("latitude", "longitude").unionByName(x.events2.select("latitude", "longitude"))
    return both.agg(r6(F.avg("latitude")).alias("latitude"), r6(F.avg("longitude")).alias("longitude"), F.count("*").alias("n"))


# travel times


@query
def tt_homogeneous(x: Lens) -> DataFrame:
    return timed(x).select("event_id", "station_id", "type", *[r6(c).alias(c) for c in ("travel_time", "azimuth", "dip", "dtdd", "dtdh", "residual")])


@query
def partials(x: Lens) -> DataFrame:
    return timed(x).select("event_id", "station_id", "type", *[r6(c).alias(c) for c in ("dx", "dy", "dz")])


@query
def tt_table(x: Lens) -> DataFrame:
    table = x.spark.sql("select g.group, d * 5e0 as distance_km, z * 3e0 as depth_km, sqrt(d * d * 25e0 + z * z * 9e0) / if(g.group = 'P', 5.8e0, 3.4e0) as travel_time from (select explode(sequence(0, 20)) as d), (select explode(sequence(0, 6)) as z), (select explode(array('P', 'S')) as `group`) g")
    ev = x.events.select(F.col("id").alias("event_id"), "depth")
    rows = picks(x).join(ev, "event_id").select("event_id", "station_id", "type", "group", "depth", ((F.col("event_id") * 37 + F.col("lower_unc") * 1000) % 1050 / 10.0).alias("km"))
    return travel_time.from_table(rows, table, "km", "depth").select("event_id", "station_id", "type", r6("travel_time").alias("travel_time"))


@query
def first_arrival(x: Lens) -> DataFrame:
    rows = timed(x).select("event_id", "station_id", F.col("type").alias("phase"), F.round("travel_time", 6).alias("travel_time"))
    return travel_time.first_arrival(rows, ["event_id", "station_id"])


# waveforms


def traces(x: Lens) -> DataFrame:
    return x.table("embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"))


def pairs_of_traces(x: Lens) -> DataFrame:
    """Each trace with the next one."""
    t = traces(x)
    return t.select("id", F.col("samples").alias("a")).join(t.select((F.col("id") - 1).alias("id"), F.col("samples").alias("b")), "id")


@query
def xcorr_windows(x: Lens) -> DataFrame:
    tt = F.col("travel_time")
    short, long = waveform.xcorr_window(F.col("t_us"), -0.5, 0.75, tt, 0.05), waveform.xcorr_window(F.col("t_us"), -0.5, 0.75, tt, 0.05, 0.5)
    rows = timed(x).withColumn("travel_time", F.round("travel_time", 3))
    return rows.select("event_id", "station_id", "type", short[0].alias("start_us"), short[1].alias("end_us"), long[0].alias("long_start_us"), long[1].alias("long_end_us"))


@query
def trace_pearson(x: Lens) -> DataFrame:
    return pairs_of_traces(x).select("id", r6(waveform.pearson(F.col("a"), F.col("b"))).alias("coefficient"))


@query
def l2_transform(x: Lens) -> DataFrame:
    n = waveform.l2_norm(F.col("a"), F.col("b"))
    return pairs_of_traces(x).select("id", r6(F.array_max(n)).alias("top"), r6(F.aggregate(n, F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query
def rt_transform(x: Lens) -> DataFrame:
    r, t = waveform.radial_transverse(F.col("a"), F.col("b"), (F.col("id") % 360).cast("double"))
    return pairs_of_traces(x).select("id", r6(r[0]).alias("r0"), r6(t[0]).alias("t0"), r6(F.array_max(r)).alias("r"), r6(F.array_max(t)).alias("t"))


@query
def demean_slice(x: Lens) -> DataFrame:
    s = waveform.sliced(waveform.demeaned(F.col("samples")), F.lit(0), F.lit(100.0), F.col("id") % 7 * 50_000, F.col("id") % 7 * 50_000 + 205_000)
    return traces(x).select("id", F.size(s).cast("bigint").alias("n"), r6(s[0]).alias("first"), r6(F.element_at(s, -1)).alias("last"))


@query
def cross_correlate(x: Lens) -> DataFrame:
    rows = pairs_of_traces(x).select("id", F.slice("a", 17, 32).alias("samples1"), F.col("b").alias("samples2"), F.lit(100.0).alias("sfreq"))
    found = waveform.cross_correlate(rows, 0.1)
    return found.select("id", F.col("valid").cast("int").alias("valid"), r6("coefficient").alias("coefficient"), r6("lag").alias("lag"))


@query
def resample(x: Lens) -> DataFrame:
    rows = waveform.resampled(traces(x).select("id", "samples", F.lit(100.0).alias("sfreq")), 60.0)
    s = F.col("samples")
    total = F.aggregate(F.transform(s, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("id", F.size(s).cast("bigint").alias("n"), "sfreq", r6(s[0]).alias("first"), r6(F.element_at(s, -1)).alias("last"), r6(total).alias("weighed"))


# the system and its solution


def edges_of(x: Lens) -> DataFrame:
    return graph.oriented(neighbours.select_neighbours(cat1(x), SELECTION))


@query
def double_differences(x: Lens) -> DataFrame:
    rows = system.double_differences(edges_of(x), timed(x))
    return rows.select("ref_id", "neigh_id", "type", "station_id", r6("residual").alias("residual"), r6("weight").alias("weight"))


def weighted(x: Lens) -> DataFrame:
    rows = system.double_differences(edges_of(x), timed(x)).withColumn("residual", r6("residual"))
    return system.reweighted(rows.withColumn("part", F.col("ref_id") % 8), "part", 4.0)


@query
def lagged_differences(x: Lens) -> DataFrame:
    """Double differences with lags, of which some are too weak or not valid."""
    edges = edges_of(x)
    h = F.col("ref_id") * 7 + F.col("neigh_id") * 13
    cache = edges.select("ref_id", "neigh_id", "type", "station_id", (h % 5 > 0).alias("valid"), ((h % 199 - 99) / 99.0).alias("coefficient"), ((h % 21 - 10) / 100.0).alias("lag"))
    rows = system.double_differences(edges, timed(x), cache)
    return rows.select("ref_id", "neigh_id", "type", "station_id", r6("residual").alias("residual"), r6("weight").alias("weight"), F.col("xcorr_used").cast("int").alias("used"))


@query
def residual_weights(x: Lens) -> DataFrame:
    return weighted(x).groupBy("part").agg(F.count("*").alias("n"), r6(F.max("mad")).alias("mad"), F.round(F.sum("final_weight"), 3).alias("weight"))


@query
def tt_constraint_rows(x: Lens) -> DataFrame:
    rows = system.constraint_rows(weighted(x), timed(x), 0.3)
    return rows.select("event_id", "type", "station_id", "n", F.round("weight", 5).alias("weight"), r6("residual").alias("residual"))


@query
def column_norms(x: Lens) -> DataFrame:
    return system.column_norms(system.coefficients(weighted(x), timed(x))).select("event_id", "axis", "n", F.round("norm", 4).alias("norm"))


def options() -> relocate.Options:
    return relocate.Options(iterations=5, s_km_s=3.4, omega=(0.1, 0.1), selection=SELECTION)


@query
def relocate_multi(x: Lens) -> DataFrame:
    return relocate.relocate_catalog(cat1(x), picks(x), options())


@query
def relocate_single(x: Lens) -> DataFrame:
    new = x.events.where("id % 50 = 0")
    old = Catalog(x.stations, x.events.where("id % 50 <> 0"), x.phases)
    return relocate.relocate_single(old, Catalog(x.stations, new, x.phases), picks(x), options())


# real time


def updates(x: Lens) -> DataFrame:
    return x.origins.select(F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("public_id"), F.timestamp_seconds(F.lit(1577836800) + F.col("created_s")).alias("time"), "seq", "author")


@query
def debounce_latest(x: Lens) -> DataFrame:
    rows = realtime.debounced(realtime.latest(updates(x).groupBy("public_id", "time").agg(F.max("seq").alias("seq")), "1 hour"), "600 seconds")
    return rows.select("public_id", F.unix_seconds("time").alias("time_s"), "seq", "updates", F.unix_seconds("due").alias("due_s"))


@query
def profile_routing(x: Lens) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    profiles = [("north", geo.in_rectangle(lat, lon, 47.0, 48.0, 7.0, 9.5)), ("centre", geo.in_circle(lat, lon, 46.8, 8.4, 30.0)), ("rest", lat < 46.8)]
    return realtime.routed(x.origins, profiles).groupBy("profile").agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


@query
def tumbling(x: Lens) -> DataFrame:
    rows = realtime.counts(updates(x), "1 hour", key="author")
    return rows.select("author", F.unix_seconds("start").alias("start_s"), "n")


@query
def sliding(x: Lens) -> DataFrame:
    rows = realtime.counts(updates(x), "1 hour", "20 minutes", key="author")
    return rows.select("author", F.unix_seconds("start").alias("start_s"), "n")


@query
def session(x: Lens) -> DataFrame:
    """Sessions of each author: updates that follow within five minutes."""
    w = F.session_window("time", "300 seconds")
    rows = updates(x).groupBy("author", w.alias("w")).agg(F.count("*").alias("n"))
    return rows.select("author", F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "n")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relocated catalog: neighbours, clusters, and the solution of each; sparse catalogs need wide neighbourhoods."""
    x = Lens(spark, sf_dir)
    wide = neighbours.Selection(max_km=20.0, min_neighbours=4, max_neighbours=20, min_phases=4)
    return relocate.relocate_catalog(cat1(x), picks(x), relocate.Options(iterations=5, s_km_s=3.4, omega=(0.1, 0.1), selection=wide))


# records, growing windows, streams' twins, and SQL by text


def records(x: Lens) -> DataFrame:
    """Traces cut in records of 16 samples at 100 Hz, a second third of which overlap by two samples; a third miss five before the third record."""
    t = traces(x).select("id", "samples", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"))
    first = F.when(F.col("id") % 3 == 0, F.col("r") * 14).when(F.col("id") % 3 == 1, F.col("r") * 16).otherwise(F.col("r") * 16 + F.when(F.col("r") >= 2, 5).otherwise(0))
    rows = t.withColumn("first", first.cast("int"))
    return rows.select("id", (F.col("id") * 1_000_000 + F.col("first") * 10_000).alias("start_us"), F.lit(100.0).alias("sfreq"), F.slice("samples", F.col("first") + 1, 16).alias("samples"))


@query
def record_traces(x: Lens) -> DataFrame:
    found = record_ops.assembled(records(x), ["id"], stretch_us=250_000)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return found.select("id", "segment", "stretch", "start_us", "end_us", F.size("samples").cast("bigint").alias("n"), r6(F.col("samples")[0]).alias("first"), r6(total).alias("total"))


@query
def trace_windows(x: Lens) -> DataFrame:
    start = F.col("id") * 1_000_000 + F.col("id") % 7 * 30_000 + 5_000
    asked = traces(x).select(F.col("id").alias("request_id"), "id", start.alias("start_us"), (start + 150_000 + F.col("id") % 5 * 60_000).alias("end_us"))
    got = record_ops.loaded(asked, record_ops.assembled(records(x), ["id"], stretch_us=250_000), ["id"], stretch_us=250_000)
    return got.select("id", "status", r6("availability").alias("availability"), "trace_start_us", F.size("samples").cast("bigint").alias("n"), r6(F.col("samples")[0]).alias("first"), r6(F.element_at("samples", -1)).alias("last"))


@query
def growing_requests(x: Lens) -> DataFrame:
    req = x.phases.select("station_id", (F.col("t_us") - 20_000_000).alias("start_us"), (F.col("t_us") + 25_000_000).alias("end_us"))
    return joins.merge_growing(req, ["station_id"], 0.1)


@query
def interval_join(x: Lens) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1577836800) + F.col("created_s"))
    manual = x.origins.where("mode = 'manual'").select("event_id", F.col("seq").alias("manual"), at.alias("manual_time"))
    automatic = x.origins.where("mode = 'automatic'").select("event_id", F.col("seq").alias("automatic"), at.alias("automatic_time"))
    found = realtime.joined_within(manual, automatic, "event_id", "manual_time", "automatic_time", "30 minutes")
    return found.select("event_id", "manual", "automatic", (F.unix_seconds("automatic_time") - F.unix_seconds("manual_time")).alias("after_s"))


@query
def sql_functions(x: Lens) -> DataFrame:
    register(x.spark)
    pairs = spatial.nearest_within(x.events, 3.0, 4)  # all that four rows of each partition can need
    return x.spark.sql(
        """SELECT n.ref_id, n.neigh_id, n.rank, round(n.distance, 6) AS distance, round(quake_distance(a.latitude, a.longitude, b.latitude, b.longitude, a.depth), 6) AS flat,
             round(quake_azimuth(a.latitude, a.longitude, b.latitude, b.longitude), 6) AS azimuth, round(quake_move(a.latitude, a.longitude, 12D, 350D, 5D).longitude, 6) AS moved,
             round(quake_bilinear(0.25D, 0.5D, a.depth, b.depth, a.latitude, b.longitude), 6) AS mixed, round(quake_mean_angle(0.5D, 350D, a.depth), 6) AS middle
           FROM nearest_rows(TABLE(SELECT ref_id, neigh_id, distance, 4 AS k FROM {pairs}) PARTITION BY ref_id ORDER BY (distance, neigh_id)) n
           JOIN {events} a ON a.id = n.ref_id JOIN {events} b ON b.id = n.neigh_id""",
        pairs=pairs, events=x.events,
    )
