"""Travel times: straight rays in a homogeneous medium, and tables over distance and depth.

A travel time spec here is a function of columns; the relocation, which works on arrays inside tasks, takes ``relocate.straight_rays`` or
``relocate.table_times``."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

Columns = dict[str, Column]


def homogeneous(p_km_s: float, s_km_s: float) -> Callable[..., Columns]:
    """travel_time (s), azimuth (degrees), dip (0 down, 180 up), dtdd (s/degree), dtdh (s/km); NULL for phases other than P and S."""

    def compute(lat: Column, lon: Column, depth: Column, st_lat: Column, st_lon: Column, elevation: Column, phase: Column) -> Columns:
        v = F.when(phase == "P", F.lit(p_km_s)).when(phase == "S", F.lit(s_km_s))
        along = geo.distance(lat, lon, st_lat, st_lon, (depth - elevation / 1000.0) / 2)
        up = depth + elevation / 1000.0
        dip = F.atan2(up, along)
        return {
            "travel_time": F.sqrt(along * along + up * up) / v,
            "azimuth": F.degrees(geo.azimuth(lat, lon, st_lat, st_lon)),
            "dip": F.degrees(dip) + 90.0,
            "dtdd": F.cos(dip) / geo.km2deg(v),
            "dtdh": F.sin(dip) / v,
        }

    return compute


def partials(azimuth: Column, dtdd: Column, dtdh: Column) -> Columns:
    """Change of the travel time in s per km of the event's move east, north and down."""
    slow, turn = dtdd / (math.pi * geo.EARTH_KM / 180.0), F.radians(90.0 - azimuth)
    return {"dx": -F.cos(turn) * slow, "dy": -F.sin(turn) * slow, "dz": -dtdh}


def with_travel_times(picks: DataFrame, events: DataFrame, stations: DataFrame, ttt: Callable[..., Columns], group: str = "group") -> DataFrame:
    """picks (event_id, station_id, t_us, group) with travel times, partials and residual (observed less computed, s)."""
    ev = events.select(F.col("id").alias("event_id"), F.col("t_us").alias("_t0"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col("depth").alias("_dep"))
    st = stations.select(F.col("id").alias("station_id"), F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"), F.col("elevation").alias("_elev"))
    rows = picks.join(ev, "event_id").join(st, "station_id")
    rows = rows.withColumns(ttt(*[F.col(c) for c in ("_lat", "_lon", "_dep", "_slat", "_slon", "_elev")], F.col(group)))
    rows = rows.withColumns(partials(F.col("azimuth"), F.col("dtdd"), F.col("dtdh")))
    rows = rows.withColumn("residual", (F.col("t_us") - F.col("_t0")).cast("double") / 1e6 - F.col("travel_time"))
    return rows.drop("_t0", "_lat", "_lon", "_dep", "_slat", "_slon", "_elev")


def from_table(picks: DataFrame, table: DataFrame, distance: str, depth: str, group: str = "group") -> DataFrame:
    """picks with travel_time interpolated in a table (group, distance_km, depth_km, travel_time) that is a regular grid.

    Picks meet their cell, with its four corners, by an equality join on grid numbers; what lies outside the grid gets NULL."""
    steps = table.groupBy(group).agg(
        F.min("distance_km").alias("x0"), F.min("depth_km").alias("z0"), F.max("distance_km").alias("x1"), F.max("depth_km").alias("z1"),
        F.count_distinct("distance_km").alias("nx"), F.count_distinct("depth_km").alias("nz"),
    ).withColumns({"sx": (F.col("x1") - F.col("x0")) / (F.col("nx") - 1), "sz": (F.col("z1") - F.col("z0")) / (F.col("nz") - 1)})
    rows = picks.join(F.broadcast(steps), group)  # a row for each phase group
    inside = F.col(distance).between(F.col("x0"), F.col("x1")) & F.col(depth).between(F.col("z0"), F.col("z1"))
    fx, fz = (F.col(distance) - F.col("x0")) / F.col("sx"), (F.col(depth) - F.col("z0")) / F.col("sz")
    # the last grid line belongs to the cell before it
    rows = rows.withColumns({"_i": F.least(F.floor(fx), F.col("nx") - 2), "_k": F.least(F.floor(fz), F.col("nz") - 2)}).withColumns({"_fx": fx - F.col("_i"), "_fz": fz - F.col("_k"), "_in": inside})
    grid = table.join(F.broadcast(steps), group).select(
        group, F.round((F.col("distance_km") - F.col("x0")) / F.col("sx")).cast("bigint").alias("_gi"), F.round((F.col("depth_km") - F.col("z0")) / F.col("sz")).cast("bigint").alias("_gk"), F.col("travel_time").alias("_tt")
    )
    # cells of the grid with their corners, so that a pick meets one row
    corners = [(a, b) for a in (0, 1) for b in (0, 1)]
    of = F.explode(F.array(*(F.struct((F.col("_gi") - a).alias("_i"), (F.col("_gk") - b).alias("_k"), F.lit(2 * a + b).alias("c")) for a, b in corners)))
    cells = grid.withColumn("_of", of).groupBy(group, "_of._i", "_of._k").agg(*[F.max(F.when(F.col("_of.c") == k, F.col("_tt"))).alias(f"_c{k}") for k in range(4)])
    found = rows.join(cells, [group, "_i", "_k"], "left")
    return found.withColumn("travel_time", F.when(F.col("_in"), geo.bilinear(F.col("_fx"), F.col("_fz"), *[F.col(f"_c{k}") for k in range(4)]))).select(*picks.columns, "travel_time")


def first_arrival(times: DataFrame, keys: list[str]) -> DataFrame:
    """Of all phases' travel times (keys, phase, travel_time) the earliest; ties by phase."""
    w = Window.partitionBy(*keys).orderBy("travel_time", "phase")
    return times.where("travel_time is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
