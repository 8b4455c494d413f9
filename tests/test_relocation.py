"""Known hypocentres are found again, with either solver, and the solvers agree with dense algebra."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeframe import tables
from quakeframe.functions import geo
from quakeframe.operators import catalog, graph, neighbours, spatial, waveform
from quakeframe.plans import relocate, solver
from quakeframe.schema import Catalog

KM = np.pi * 6371.00877141506 / 180


def synthetic(spark, lat0, lon0, seed=1, n=30):
    """A cloud of events with exact arrival times, and the same with moved hypocentres."""
    rng = np.random.default_rng(seed)
    true = np.stack([lat0 + rng.uniform(-2, 2, n) / KM, lon0 + rng.uniform(-2, 2, n) / KM / np.cos(np.radians(lat0)), rng.uniform(4, 8, n)], 1)
    ang = np.arange(8) * np.pi / 4
    st = np.stack([lat0 + np.cos(ang) * 20 / KM, lon0 + np.sin(ang) * 25 / KM / np.cos(np.radians(lat0)), np.linspace(0, 2000, 8)], 1)
    wrap = lambda x: (x + 180) % 360 - 180
    t0 = 1_600_000_000_000_000 + np.arange(n) * 60_000_000
    moved = true.copy()
    moved[:, 0] += rng.normal(0, 0.3, n) / KM
    moved[:, 1] += rng.normal(0, 0.3, n) / KM
    moved[:, 2] += rng.normal(0, 0.3, n)
    shift = rng.normal(0, 0.05, n)
    for x in (moved, shift):
        x -= x.mean(axis=0) - (true.mean(axis=0) if x is moved else 0)
    true[:, 1], st[:, 1], moved[:, 1] = wrap(true[:, 1]), wrap(st[:, 1]), wrap(moved[:, 1])
    stations = pd.DataFrame({"id": [f"N.S{k}." for k in range(8)], "latitude": st[:, 0], "longitude": st[:, 1], "elevation": st[:, 2]})
    events = pd.DataFrame({"id": np.arange(n), "t_us": t0 + np.rint(shift * 1e6).astype(np.int64), "latitude": moved[:, 0], "longitude": moved[:, 1], "depth": moved[:, 2]})
    rows = []
    for k in range(8):
        for phase, v in (("P", 5.8), ("S", 3.36)):
            tt, _ = relocate._ray(true[:, 0], true[:, 1], true[:, 2], np.tile(st[k], (n, 1)), np.full(n, v))
            rows += [(i, f"N.S{k}.", int(t0[i] + round(tt[i] * 1e6)), phase, 0.01, 0.01) for i in range(n)]
    phases = pd.DataFrame(rows, columns=["event_id", "station_id", "t_us", "type", "lower_unc", "upper_unc"])
    return Catalog(*(spark.createDataFrame(x) for x in (stations, events, phases))), true, t0


@pytest.mark.parametrize("lat0,lon0,method", [(46.5, 8.0, "LSMR"), (-20.0, 179.995, "LSQR"), (75.0, 20.0, "LSMR")])
def test_recovery(spark, lat0, lon0, method):
    cat, true, t0 = synthetic(spark, lat0, lon0)
    picks = catalog.with_processing(cat, ["P"], ["S"], [0.0, 0.1])
    o = relocate.Options(solver=method, omega=(0.3, 0.3), selection=neighbours.Selection(max_km=10, min_neighbours=4, max_neighbours=20))
    got = relocate.relocate_catalog(cat, picks, o).toPandas().set_index("event_id").sort_index()
    assert len(got) == len(true) and got.cluster_id.nunique() == 1
    lon = (got.longitude - true[:, 1] + 180) % 360 - 180
    across = np.hypot((got.latitude - true[:, 0]) * KM, lon * KM * np.cos(np.radians(lat0)))
    assert across.max() < 0.010 and abs(got.depth - true[:, 2]).max() < 0.050
    assert abs(got.t_us - t0).max() < 10_000 and (got.final_rms < got.start_rms).all()


def test_single_event(spark):
    cat, true, t0 = synthetic(spark, 46.5, 8.0, seed=4)
    events = cat.events.toPandas()
    for i, c in enumerate(("latitude", "longitude", "depth")):
        events.loc[events.id != 5, c] = true[events.id != 5, i]
    events.loc[events.id != 5, "t_us"] = t0[events.id != 5]
    ev = spark.createDataFrame(events)
    picks = catalog.with_processing(cat, ["P"], ["S"], [0.0, 0.1])
    o = relocate.Options(selection=neighbours.Selection(max_km=10, min_neighbours=4, max_neighbours=20))
    got = relocate.relocate_single(Catalog(cat.stations, ev.where("id <> 5"), cat.phases), Catalog(cat.stations, ev.where("id = 5"), cat.phases), picks, o).collect()
    assert [r.event_id for r in got] == [5]
    assert abs(got[0].latitude - true[5, 0]) * KM < 0.01 and abs(got[0].depth - true[5, 2]) < 0.05
    alone = relocate.Options(selection=neighbours.Selection(max_km=10, min_neighbours=1000))
    assert not relocate.relocate_single(Catalog(cat.stations, ev.where("id <> 5"), cat.phases), Catalog(cat.stations, ev.where("id = 5"), cat.phases), picks, alone).collect()


@pytest.mark.parametrize("damp", [0.0, 0.5])
def test_solvers(spark, damp):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(30, 8)), rng.normal(size=30)
    want = np.linalg.solve(a.T @ a + damp**2 * np.eye(8), a.T @ b)
    for f in (solver.lsmr, solver.lsqr):
        x, stopped = f(lambda x: a @ x, lambda y: a.T @ y, b, 8, damp, 1e-12)
        assert np.allclose(x, want, atol=1e-6) and stopped == solver.SOLVED
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(8)], "row int, col int, value double")
    right = spark.createDataFrame([(i, float(b[i])) for i in range(30)], "row int, value double")
    for method in ("LSMR", "LSQR"):
        found, stopped = solver.solve_distributed(m, right, damp, 1e-12, method=method)
        x, same = solver.solve(method, lambda x: a @ x, lambda y: a.T @ y, b, 8, damp, 1e-12)
        assert np.allclose([r.x for r in found.orderBy("col").collect()], x, atol=1e-9) and stopped == same == solver.SOLVED
        tables.drop(found)
    assert not spark.catalog.listTables()


def test_a_product_shuffles_sums_alone(spark):
    """The matrix and the vectors lie where they are used."""
    m = spark.range(400).select((F.col("id") % 90).alias("row"), (F.col("id") % 37).alias("col"), F.lit(1.0).alias("value"))
    by_row, by_col = tables.bucketed(m, "row", 4), tables.bucketed(m, "col", 4)
    u = tables.bucketed(spark.range(90).select(F.col("id").alias("row"), F.lit(1.0).alias("u")), "row", 4)
    cols = tables.bucketed(spark.range(37).select(F.col("id").alias("col"), *(F.lit(1.0).alias(c) for c in ("v", "h", "h_bar", "x"))), "col", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = solver.products(by_row, by_col, u, cols, 1.0, 1.0, 1.0)
        for df in (left, right(u, 1.0, 1.0)):
            assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tables.drop(by_row, by_col, u, cols)


def test_stop_codes_of_tables(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1e-9)], "row int, col int, value double")
    ones, none = (spark.createDataFrame([(0, v), (1, v)], "row int, value double") for v in (1.0, 0.0))
    for right, tolerance, most, want in ((ones, 1e-16, None, solver.CONDITION), (none, 1e-6, None, solver.ZERO), (ones, 1e-30, 1, solver.LIMIT)):
        x, stopped = solver.solve_distributed(m, right, 0.0, tolerance, most, 1e30 if want == solver.LIMIT else solver.MOST_CONDITION)
        assert stopped == want and x.count() == 2
        tables.drop(x)


def test_radius_across_the_date_line_and_pole(spark):
    pts = spark.createDataFrame([(1, 10.0, 179.99, 5.0), (2, 10.0, -179.99, 5.0), (3, 89.99, 0.0, 5.0), (4, 89.99, 180.0, 5.0), (5, 0.0, 0.0, 5.0)], "id long, latitude double, longitude double, depth double")
    assert {(r.ref_id, r.neigh_id) for r in spatial.neighbours_within(pts, 5.0).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_components_keep_lone_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 50)], "a long, b long")
    got = dict(graph.components(spark.range(53), edges).collect())
    assert {got[i] for i in range(41)} == {0} and got[50] == got[51] == 50 and got[52] == 52 and len(got) == 53


def test_projections_round_trip(spark):
    df = spark.createDataFrame([(46.7, 8.5), (46.2, 7.9)], "lat double, lon double")
    x, y = geo.to_flat(F.col("lat"), F.col("lon"), 46.5, 8.0, 25.0)
    for r in df.select("lat", "lon", *geo.from_flat(x, y, 46.5, 8.0, 25.0)).collect():
        assert abs(r[0] - r[2]) < 1e-9 and abs(r[1] - r[3]) < 1e-9
    near = [geo.transverse_mercator(F.col("lat"), F.col("lon"), 46.5, 8.0, "Sphere"), geo.lambert(F.col("lat"), F.col("lon"), 46.5, 8.0, 46.4, 46.6, "Sphere"), geo.azimuthal_equidistant(F.col("lat"), F.col("lon"), 46.5, 8.0)]
    for r in df.select(*[c for p in near for c in p]).collect():
        assert abs(r[0] - r[2]) < 0.05 and abs(r[1] - r[3]) < 0.05 and abs(r[0] - r[4]) < 0.05 and abs(r[1] - r[5]) < 0.05


@pytest.mark.parametrize("lat0,lon0", [(46.5, 8.0), (-33.0, 179.7), (68.0, -150.0)])
def test_inverse_projections(spark, lat0, lon0):
    """Back within a millimetre, over the date line too."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(lat0 + a), float((lon0 + b + 180) % 360 - 180)) for a, b in rng.uniform(-1.5, 1.5, (40, 2))], "lat double, lon double")
    lat, lon, line = F.col("lat"), F.col("lon"), (lat0, lon0, lat0 - 0.5, lat0 + 0.7)
    both = {
        "tm": (geo.transverse_mercator(lat, lon, lat0, lon0, "Bessel"), lambda x, y: geo.from_transverse_mercator(x, y, lat0, lon0, "Bessel")),
        "lcc": (geo.lambert(lat, lon, *line, "Airy"), lambda x, y: geo.from_lambert(x, y, *line, "Airy")),
        "aeqd": (geo.azimuthal_equidistant(lat, lon, lat0, lon0, 6371.0), lambda x, y: geo.from_azimuthal_equidistant(x, y, lat0, lon0, 6371.0)),
        "sdc": (geo.short_distance(lat, lon, lat0, lon0, 25.0), lambda x, y: geo.from_short_distance(x, y, lat0, lon0, 25.0)),
    }
    for name, (xy, back) in both.items():
        p = df.select("lat", "lon", xy[0].alias("x"), xy[1].alias("y"))
        got = p.select("*", *(c.alias(n) for c, n in zip(back(F.col("x"), F.col("y")), ("lat2", "lon2"), strict=True))).toPandas()
        assert (got[["x", "y"]].abs() < 400).all().all()
        off = np.hypot((got.lat - got.lat2) * KM, ((got.lon - got.lon2 + 180) % 360 - 180) * KM)
        assert off.max() < 1e-6, (name, off.max())
    north = df.select(*geo.short_distance(F.lit(lat0 + 0.1), F.lit(lon0), lat0, lon0, 25.0)).first()
    assert abs(np.degrees(np.arctan2(*north)) - 25.0) < 1e-9  # a map's direction is the rotation more
    angle = df.select(geo.to_map_angle(F.lit(350.0), 25.0), geo.from_map_angle(F.lit(15.0), 25.0)).first()
    assert tuple(angle) == (15.0, 350.0)


@pytest.mark.parametrize("shift,scale,offset", [(0, 1.0, 0.0), (0, -1.0, 0.0), (12, 3.0, 5.0), (-9, -0.1, -2.0)])
def test_lag(shift, scale, offset):
    f, i = 80.0, np.arange(240)
    base = np.where((i >= 80) & (i < 160), np.sin(2 * np.pi * 11 * i / f) + np.sin(2 * np.pi * i / f), 0.0)
    other = np.roll(base, shift) * scale + offset
    cc, lag = waveform.best_lag(base[60:180], other, f, 0.3)
    assert abs(cc) > 0.99 and abs(lag - shift / f) <= 2 / f and np.sign(cc) == np.sign(scale)
    cc2, lag2 = waveform.best_lag(other, base[60:180], f, 0.3)
    assert np.isclose(cc, cc2) and np.isclose(lag, -lag2)
    assert waveform.best_lag(np.ones(10), np.ones(30), f, 0.3) == (None, None)


def test_resample_keeps_the_wave():
    f = 160.0
    x = np.sin(2 * np.pi * 5 * np.arange(800) / f)
    y = waveform.resample(x, f, 100.0)
    assert len(y) == 500
    assert np.allclose(y[100:-100], np.sin(2 * np.pi * 5 * np.arange(500) / 100.0)[100:-100], atol=0.02)
