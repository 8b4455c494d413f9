"""Grids of travel times as tables: kinds of errors, both forms, and as a relocation's spec."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeframe.functions import geo
from quakeframe.operators import catalog, grids, neighbours
from quakeframe.plans import relocate
from quakeframe.tables import settled
from tests.test_relocation import KM, synthetic

LAT, LON = 46.5, 8.0


def ray_grids(spark, stations, three_d, half=12.0, step=1.0, deep=(-3.0, 13.0), rotation=30.0, negative=None):
    """Grids of straight rays at 5.8 and 3.36 km/s around a point, for stations (pandas: id, latitude, longitude, elevation)."""
    heads, nodes, number = [], [], 0
    n_xy, nz = int(2 * half / step) + 1, int((deep[1] - deep[0]) / step) + 1
    far = np.arange(0, 46, step)
    turn = np.radians(rotation)

    def flat(lat, lon):
        x, y = (lon - LON) * geo.FLAT_KM * np.cos(np.radians(lat)), (lat - LAT) * geo.FLAT_KM
        return x * np.cos(turn) + y * np.sin(turn), y * np.cos(turn) - x * np.sin(turn)

    for s in [None, *stations.itertuples()]:
        for group, v in (("P", 5.8), ("S", 3.36)):
            for kind in ("velocity",) if s is None else ("time", "angle"):
                number += 1
                place = (LAT, LON, 0.0) if s is None else (s.latitude, s.longitude, -s.elevation / 1000)
                shape = (n_xy, n_xy, nz, -half, -half, deep[0]) if three_d else (1, len(far), nz, 0.0, 0.0, deep[0])
                heads.append((number, kind, group, three_d, *shape, step, step, step, LAT, LON, rotation, *place, "m/s" if kind == "velocity" else "km/s"))
                i, j, k = (a.ravel() for a in np.meshgrid(*(np.arange(m) for m in shape[:3]), indexing="ij"))
                z = deep[0] + k * step
                if s is None:
                    value, az = np.full(len(z), v * 1000), np.full(len(z), np.nan)
                else:
                    sx, sy = flat(s.latitude, s.longitude)
                    dx, dy = sx - (-half + i * step), sy - (-half + j * step)
                    along, up = (np.hypot(dx, dy) if three_d else j * step), z - place[2]
                    value = np.hypot(along, up) / v if kind == "time" else 90 + np.degrees(np.arctan2(up, along))
                    az = np.degrees(np.arctan2(dx, dy)) % 360
                if negative == number:
                    value = -value
                nodes.append(pd.DataFrame({"grid_id": number, "ix": i, "iy": j, "iz": k, "value": value, "azimuth": az, "quality": 5}))
    headers = settled(spark.createDataFrame(heads, grids.HEADER))
    cells = settled(grids.make_cells(headers, spark.createDataFrame(pd.concat(nodes))))
    return grids.GridTables(headers, cells, settled(grids.assign(spark.createDataFrame(stations), headers, 50.0)))


STATIONS = pd.DataFrame({"id": ["A", "B"], "latitude": [46.55, 46.4], "longitude": [8.05, 7.9], "elevation": [1000.0, 0.0]})


@pytest.mark.parametrize("three_d", [True, False])
def test_points_in_cells(spark, three_d):
    rng = np.random.default_rng(1)
    pts = pd.DataFrame({"n": np.arange(60), "_lat": LAT + rng.uniform(-0.12, 0.12, 60), "_lon": LON + rng.uniform(-0.15, 0.15, 60), "_dep": rng.uniform(-4, 14, 60), "station_id": np.where(np.arange(60) % 3 == 2, "none", np.where(np.arange(60) % 2, "A", "B")), "group": np.where(np.arange(60) % 5 < 3, "P", "S")})
    pts = pts.merge(STATIONS.rename(columns={"id": "station_id", "latitude": "_slat", "longitude": "_slon"}), "left")
    g = ray_grids(spark, STATIONS, three_d)
    got = g.compute(spark.createDataFrame(pts)).toPandas().sort_values("n")
    away = (np.abs(np.stack(flat_of(got, 30.0))).max(axis=0) > 12) if three_d else np.zeros(60, bool)
    outside = away | (got._dep < -3).to_numpy() | (got._dep > 13).to_numpy()
    want = np.where(got.station_id == "none", "no_grid", np.where(outside, "out_of_grid", "ok"))
    assert (got.found == want).all() and set(want) == {"no_grid", "out_of_grid", "ok"}
    ok = got[got.found == "ok"]
    v = np.where(ok.group == "P", 5.8, 3.36)
    tt, slope = relocate._ray(*(ok[c].to_numpy() for c in ("_lat", "_lon", "_dep")), ok[["_slat", "_slon", "elevation"]].to_numpy(), v)
    near = np.hypot((ok._slat - ok._lat) * KM, (ok._slon - ok._lon) * KM * 0.69) > 3  # close to the station cells are coarse
    assert abs(ok.travel_time - tt)[near].max() < 0.03 and got[got.found != "ok"][["travel_time", "dip", "dtdd"]].isna().all().all()
    east = -np.sin(np.radians(ok.azimuth)) * ok.dtdd / KM
    assert abs(east - slope[:, 0])[near].max() < 0.02 and abs(-ok.dtdh - slope[:, 2])[near].max() < 0.02


def flat_of(df, rotation):
    x, y, t = (df._lon - LON) * geo.FLAT_KM * np.cos(np.radians(df._lat)), (df._lat - LAT) * geo.FLAT_KM, np.radians(rotation)
    return x * np.cos(t) + y * np.sin(t), y * np.cos(t) - x * np.sin(t)


def test_bad_cells_have_kinds(spark):
    pts = spark.createDataFrame([("A", "P", 46.5, 8.0, 5.0, 46.55, 8.05), ("A", "S", 46.5, 8.0, 5.0, 46.55, 8.05)], "station_id string, `group` string, _lat double, _lon double, _dep double, _slat double, _slon double")
    g = ray_grids(spark, STATIONS[:1], True, negative=3)
    assert {r.group: r.found for r in g.compute(pts).collect()} == {"P": grids.NEGATIVE, "S": grids.FOUND}
    assert {r.found for r in replace(g, least_quality=6).compute(pts).collect()} == {grids.NEGATIVE, grids.LOW_QUALITY}
    edge = spark.createDataFrame([("B", "P", LAT, LON, 13.0, 46.4, 7.9), ("B", "P", LAT, LON, -3.0, 46.4, 7.9), ("B", "P", LAT, LON, 13.001, 46.4, 7.9)], pts.schema)
    assert sorted(r.found for r in ray_grids(spark, STATIONS[1:], True).compute(edge).collect()) == [grids.FOUND, grids.FOUND, grids.OUT_OF_GRID]


def some_points(spark, n=60):
    rng = np.random.default_rng(2)
    pts = pd.DataFrame({"n": np.arange(n), "_lat": LAT + rng.uniform(-0.12, 0.12, n), "_lon": LON + rng.uniform(-0.15, 0.15, n), "_dep": rng.uniform(-4, 14, n), "station_id": np.array(["A", "B", "none"])[np.arange(n) % 3], "group": np.where(np.arange(n) % 5 < 3, "P", "S")})
    return spark.createDataFrame(pts.merge(STATIONS.drop(columns="elevation").rename(columns={"id": "station_id", "latitude": "_slat", "longitude": "_slon"}), "left"))


def test_points_are_shuffled_once_for_all_kinds(spark):
    """For their stations, for velocities if these are too many to broadcast, and for times and angles together; what has no cell isn't all of one key."""
    g, pts = ray_grids(spark, STATIONS, True), some_points(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = g.compute(pts)
        plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    steps = [x for x in plan.split("\n\n") if ") Exchange\n" in x and ("[n#" in x or ", n#" in x)]
    assert len(steps) == 3
    away = grids._placed(pts.where("station_id = 'none'").join(g.places, ["station_id", "group"], "left"), grids.TIME)
    assert {r[0] for r in away.select("_time_missing").collect()} == {grids.NO_GRID} and away.select("_time_cell").distinct().count() > 10


def test_angles_of_another_form(spark):
    """Times of 3-D grids with angles over distance and depth: each is found in its own cells; a station without a grid of angles has none found."""
    deep, flat, pts = ray_grids(spark, STATIONS, True), ray_grids(spark, STATIONS, False, negative=None), some_points(spark)
    parts = []
    for c in ("headers", "cells", "assigned"):
        own, other = getattr(deep, c), getattr(flat, c).withColumn("grid_id", F.col("grid_id") + 100)
        kind = F.col("kind") == grids.ANGLE
        ids = [r[0] for r in flat.headers.where(kind).select("grid_id").collect()]
        of_angle = F.col("grid_id").isin([*ids, *(k + 100 for k in ids)])  # both number alike
        parts.append(settled(own.where(~of_angle).unionByName(other.where(of_angle))))
    mixed = grids.GridTables(*parts)
    assert deep.alike and flat.alike and not mixed.alike
    a, b, c = (g.compute(pts).toPandas().sort_values("n").reset_index(drop=True) for g in (mixed, deep, flat))
    ok = (a.found == "ok").to_numpy()
    assert ok.sum() > 10 and (a.found == b.found.where(b.found != "ok", c.found)).all()
    assert np.allclose(a.travel_time[ok], b.travel_time[ok], atol=0) and np.allclose(a.dip[ok], c.dip[ok], atol=0) and abs(a.dip[ok] - b.dip[ok]).max() > 0
    bare = replace(deep, assigned=settled(deep.assigned.where("station_id <> 'A' or kind <> 'angle'")))
    d = bare.compute(pts).toPandas().sort_values("n").reset_index(drop=True)
    assert bare.alike and (d.found == b.found.where((d.station_id != "A") | (b.found != "ok"), grids.NO_GRID)).all()


@pytest.mark.parametrize("three_d", [True, False])
def test_relocation_by_grids(spark, three_d):
    """The same on arrays and on tables, near what straight rays give, and also if events leave the cells that are sent at first."""
    cat, true, _ = synthetic(spark, LAT, LON, n=8)
    picks = catalog.with_processing(cat, ["P"], ["S"], [0.0, 0.1])
    g = ray_grids(spark, cat.stations.toPandas(), three_d, half=6.0, step=1.0, deep=(0.0, 12.0))
    o = relocate.Options(iterations=1, damping=(0.3, 0.3), omega=(0.3, 0.3), times=g, selection=neighbours.Selection(max_km=10, min_neighbours=2, max_neighbours=20))
    obs = settled(relocate.catalog_observations(cat, picks, o))
    rays = relocate.relocate(obs, replace(o, times=None)).toPandas().set_index("event_id").sort_index()
    small = relocate.relocate(obs, o).toPandas().set_index("event_id").sort_index()
    large = relocate.relocate(obs, replace(o, most_rows=1)).toPandas().set_index("event_id").sort_index()
    tight = relocate.relocate(obs, replace(o, margin_km=-3.0 if three_d else 0.01)).toPandas().set_index("event_id").sort_index()
    for c in ("latitude", "longitude", "depth", "final_rms"):
        assert np.allclose(small[c], large[c], atol=1e-6) and np.allclose(small[c], tight[c], atol=1e-12)
    assert small.moved.all() and abs(small.latitude - rays.latitude).max() * KM < 0.1 and abs(small.depth - rays.depth).max() < 0.2
