"""Neighbours of events for double differences, and their clusters.

Edges are flat: ref_id, neigh_id, distance, and one row for each phase type and station that both have."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import Catalog
from ..tables import drop, settled
from .graph import components, oriented
from .spatial import first_radius, neighbours_within, others_reached, sharing_within


@dataclass(frozen=True)
class Selection:
    """Options; 0 or less means no limit. ``strict_ref`` holds the reference's own stations to both distance limits; otherwise a station
    passes there with either."""

    max_km: float = 5.0
    min_neighbours: int = 4
    max_neighbours: int = 40
    min_phases: int = 4
    max_phases: int = 0
    min_station_km: float = 0.0
    max_station_km: float = 0.0
    min_ratio: float = 0.0
    shells: int = 0
    strict_ref: bool = False

    @property
    def in_nearest_mode(self) -> bool:
        """Without shells, or if all neighbours are wanted, which makes shells pointless."""
        return self.shells <= 0 or self.max_neighbours <= 0


def eligible_edges(cat: Catalog, o: Selection) -> DataFrame:
    """All pairs that could be neighbours: ref_id, neigh_id, distance, type, station_id, km (reference to station).

    Events meet by the phases that they share, not by distance alone, so what is joined grows with the picks. A pair is counted once
    for both directions, and only pairs with enough phases are given both ways."""
    phases = cat.phases.select(F.col("event_id").alias("id"), "station_id", "type")  # repeated ones count once where they meet
    st = cat.stations.select(F.col("id").alias("station_id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), geo.station_depth(F.col("elevation")).alias("_depth"))
    rows = phases.join(cat.events.select("id", "latitude", "longitude", "depth"), "id").join(st, "station_id")
    rows = rows.withColumn("km", geo.distance3d(*map(F.col, ("latitude", "longitude", "depth", "_lat", "_lon", "_depth")))).drop("_lat", "_lon", "_depth")
    most, ellipsoid = (o.max_km, None) if o.in_nearest_mode else (2 * o.max_km, (2 * o.max_km, o.max_km))
    pairs = sharing_within(rows, ["station_id", "type"], most, ["id", "km"], ellipsoid, events=cat.events)
    ways = []
    for a, b in ("12", "21"):
        km, far = F.col(f"km{a}"), F.col(f"km{b}")
        lo, hi = km >= o.min_station_km, (km <= o.max_station_km) if o.max_station_km > 0 else F.lit(True)
        ok = lo & hi if o.strict_ref else lo | hi
        if o.min_ratio > 0:
            ok &= (km >= F.col("distance") * o.min_ratio) & (far >= F.col("distance") * o.min_ratio)
        if o.max_station_km > 0:
            ok &= far <= o.max_station_km
        if o.min_station_km > 0:
            ok &= far >= o.min_station_km
        if ellipsoid:
            ok &= F.col(f"in{a}")
        ways.append(ok)
    pairs = pairs.select("id1", "id2", "distance", "type", "station_id", "km1", "km2", *[ok.alias(f"ok{k}") for k, ok in enumerate(ways, 1)]).where("ok1 or ok2")
    pair = Window.partitionBy("id1", "id2")
    pairs = pairs.withColumns({f"n{k}": F.count_if(F.col(f"ok{k}")).over(pair) for k in (1, 2)}).where(F.greatest("n1", "n2") >= o.min_phases)
    way = F.array(*(F.struct(F.col(f"id{a}").alias("ref_id"), F.col(f"id{b}").alias("neigh_id"), F.col(f"km{a}").alias("km"), (F.col(f"ok{a}") & (F.col(f"n{a}") >= o.min_phases)).alias("ok")) for a, b in ("12", "21")))
    both = pairs.select(F.explode(way).alias("w"), "distance", "type", "station_id").where("w.ok").select("w.ref_id", "w.neigh_id", "distance", "type", "station_id", "w.km")
    if o.max_phases > 0:
        place = F.row_number().over(Window.partitionBy("ref_id", "neigh_id").orderBy("km", "station_id", "type"))
        return both.withColumn("_k", place).where(F.col("_k") <= o.max_phases).drop("_k")
    return both


def peel(pairs: DataFrame, least: int, most: int) -> DataFrame:
    """The pairs (ref_id, neigh_id, ...) that stay if events with fewer than ``least`` neighbours go, again and again until none does."""
    if least <= 0:
        return pairs
    if 0 < most < least:
        return pairs.limit(0)
    pairs = last = settled(pairs)  # looked at three times
    before = pairs.count()
    while True:
        stay = pairs.groupBy("ref_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("ref_id").alias("id"))
        pairs = settled(pairs.join(stay.withColumnRenamed("id", "ref_id"), "ref_id", "left_semi").join(stay.withColumnRenamed("id", "neigh_id"), "neigh_id", "left_semi"))
        now = pairs.count()
        drop(last)
        if now == before:
            return pairs
        before, last = now, pairs


def nearest_first(pairs: DataFrame, most: int) -> DataFrame:
    """The nearest ``most`` neighbours of each event; ties by id."""
    if most <= 0:
        return pairs
    w = Window.partitionBy("ref_id").orderBy("distance", "neigh_id")
    return pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def _placed(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """pairs with both ends' coordinates: lat0, lon0, dep0 of the reference, latitude, longitude, depth of the neighbour."""
    ev = events.select("id", "latitude", "longitude", "depth")
    a = ev.select(F.col("id").alias("ref_id"), F.col("latitude").alias("lat0"), F.col("longitude").alias("lon0"), F.col("depth").alias("dep0"))
    return pairs.join(a, "ref_id").join(ev.withColumnRenamed("id", "neigh_id"), "neigh_id")


def _with_shells(placed: DataFrame, o: Selection) -> DataFrame:
    """Rows of ``_placed`` with ``shell`` (0 is the innermost, NULL if outside of all) and ``octant``. The distance across is worked out once."""
    placed = placed.withColumns({"_h": geo.distance(*map(F.col, ("latitude", "longitude", "lat0", "lon0", "dep0"))), "_z": F.col("depth") - F.col("dep0")})
    shell = F.when(F.lit(False), F.lit(0))
    for k in range(o.shells):
        km = o.max_km / 2 ** (o.shells - 1 - k)
        shell = shell.when(geo.square(F.col("_h") / km) + geo.square(F.col("_z") / (2 * km)) <= 1.0, k)
    # as ``geo.octants``, the first of them
    east, north = geo.normalize_lon(F.col("longitude") - F.col("lon0")), F.col("latitude") >= F.col("lat0")
    placed = placed.withColumns({"_e": east, "_n": north})
    quarter = F.when(F.col("_n") & (F.col("_e") >= 0), 1).when((F.col("_e") >= 0) & (F.col("latitude") <= F.col("lat0")), 2).when((F.col("latitude") <= F.col("lat0")) & (F.col("_e") <= 0), 3).otherwise(4)
    return placed.withColumns({"shell": shell, "octant": quarter + F.when(F.col("_z") >= 0, 0).otherwise(4)}).drop("_h", "_z", "_e", "_n")


def by_shells(pairs: DataFrame, events: DataFrame, o: Selection) -> DataFrame:
    """Neighbours taken in turns from shells and octants: the nearest of each, then the second of each, and so on.

    The outermost of ``shells`` ellipsoids has horizontal half axes of ``max_km`` and a vertical one of twice that; each further one is half
    as large, and the innermost shell is all of its ellipsoid. A point on an octant's plane is counted in the first of its octants."""
    rows = _with_shells(_placed(pairs, events), o).where("shell is not null")
    if o.max_neighbours > 0:
        turn = Window.partitionBy("ref_id", "shell", "octant").orderBy("distance", "neigh_id")
        rows = rows.withColumn("_turn", F.row_number().over(turn))
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("ref_id").orderBy("_turn", "shell", "octant"))).where(F.col("_k") <= o.max_neighbours)
    return rows.select(*pairs.columns, "shell", "octant")


def shells_within(events: DataFrame, o: Selection) -> DataFrame:
    """ref_id, neigh_id, distance, shell, octant: what ``by_shells`` takes of all pairs within twice ``max_km``, without all of these pairs.

    Places are filled in the order of turn, shell and octant. Within a radius, only a shell that reaches beyond it may still fill a place that
    is empty. So an event is settled once enough places before the first such one are filled, and the radius, at first such that an octant
    has some four events if they were spread evenly over their extent, grows twofold for those that aren't."""
    most, wanted = 2.0 * o.max_km, o.max_neighbours
    if o.in_nearest_mode:
        return by_shells(neighbours_within(events, most), events, o)
    km, low, high, size = first_radius(events, events, 2 * max(8, wanted))
    deepest, slots, found, before = max(0.0, high or 0.0), 8 * o.shells, None, None
    left = events = events.select("id", "latitude", "longitude", "depth")
    if not size:
        return by_shells(neighbours_within(events, most), events, o)
    ends = {f"{c}{k}": n for k, names in ((1, ("lat0", "lon0", "dep0")), (2, ("latitude", "longitude", "depth"))) for c, n in zip(("latitude", "longitude", "depth"), names, strict=True)}
    while True:
        km = min(km, most)
        pairs = others_reached(left, events, km, deepest, low, high).withColumnsRenamed({"a_id": "ref_id", "b_id": "neigh_id", **ends})
        rows = _with_shells(pairs, o)
        # what lies farther or in no shell is left out behind the inlined column, as a filter before it would be taken into the join, where all of this would be worked out for each candidate
        slot = F.inline(F.array(F.struct(F.when(F.col("distance") <= km, F.col("shell") * 8 + F.col("octant") - 1).alias("slot"))))
        rows = rows.select("ref_id", "neigh_id", "distance", slot).where("slot is not null").repartition("ref_id")
        turn = Window.partitionBy("ref_id", "slot").orderBy("distance", "neigh_id")
        rows = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= wanted)
        first = F.array_sort(F.collect_list(F.struct("turn", "slot", "neigh_id", "distance")))  # of ``wanted`` for each slot at most
        rows = rows.groupBy("ref_id").agg(first.alias("all"), *(F.count_if(F.col("slot") == g).alias(f"n{g}") for g in range(slots)))
        done = F.lit(True)
        if km < most:
            whole = sum(km >= 2 * o.max_km / 2 ** (o.shells - 1 - k) for k in range(o.shells))
            rows = rows.withColumn("open", F.least(*((F.col(f"n{g}") + 1) * slots + g for g in range(8 * whole, slots)), F.lit(1 << 40)))  # turn and slot
            rows = rows.withColumns({"turn": F.floor(F.col("open") / slots), "slot": F.col("open") % slots})
            done = sum((F.least(F.col(f"n{g}"), F.col("turn") - F.when(F.lit(g) >= F.col("slot"), 1).otherwise(0)) for g in range(slots)), F.lit(0)) >= wanted
        # written before it's filtered, as a filter would repeat all of this
        rows = settled(rows.select("ref_id", F.slice("all", 1, wanted).alias("all"), done.alias("done"))).where("done")
        found = rows if found is None else found.unionByName(rows)
        if km >= most:
            break
        left = settled(left.join(rows.select(F.col("ref_id").alias("id")), "id", "left_anti"))
        drop(before)
        before = left
        if left.isEmpty():
            break
        km *= 2
    found = found.select("ref_id", F.explode("all").alias("x")).select("ref_id", "x.neigh_id", "x.distance", "x.slot")
    return found.select("ref_id", "neigh_id", "distance", F.expr("slot div 8").cast("int").alias("shell"), (F.col("slot") % 8 + 1).alias("octant"))


def select_neighbours(cat: Catalog, o: Selection) -> DataFrame:
    """ref_id, neigh_id, distance, type, station_id: the neighbours of all events that keep at least ``min_neighbours``."""
    edges = settled(eligible_edges(cat, o))
    pairs = peel(edges.groupBy("ref_id", "neigh_id").agg(F.first("distance").alias("distance")), o.min_neighbours, o.max_neighbours)
    chosen = nearest_first(pairs, o.max_neighbours) if o.in_nearest_mode else by_shells(pairs, cat.events, o).drop("shell", "octant")
    return edges.join(chosen.select("ref_id", "neigh_id"), ["ref_id", "neigh_id"], "left_semi").select("ref_id", "neigh_id", "distance", "type", "station_id")


def clusters(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, cluster_id) of the events that edges join, and the edges, each pair once, with cluster_id."""
    pairs = edges.select(F.col("ref_id").alias("a"), F.col("neigh_id").alias("b")).distinct()
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    named = components(nodes, pairs)
    return named, oriented(edges).join(named.withColumnRenamed("id", "ref_id"), "ref_id")


def to_catalog(edges: DataFrame, cat: Catalog, with_reference: bool = True) -> Catalog:
    """The neighbours of a reference's edges, and itself if asked for, with their phases and the stations of those."""
    from .catalog import extract_events

    ids = edges.select(F.col("neigh_id").alias("id"))
    if with_reference:
        ids = ids.union(edges.select("ref_id"))
    return extract_events(cat, ids.distinct())


def in_order(edges: DataFrame) -> DataFrame:
    """Edges with ``place``: their order by station, phase and neighbour within each reference."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("ref_id").orderBy("station_id", "type", "neigh_id")))


def in_chunks(edges: DataFrame, n: int) -> DataFrame:
    """Edges with ``chunk``: 0 to n - 1, of near equal size, by distance within each reference."""
    return edges.withColumn("chunk", F.ntile(n).over(Window.partitionBy("ref_id").orderBy("distance", "neigh_id", "station_id", "type")) - 1)
