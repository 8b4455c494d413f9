"""Relocation with lags from traces, with tables of travel times, of large clusters, and in two steps."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeframe.operators import catalog, neighbours, xcorr
from quakeframe.plans import presets, rebuild, relocate, solver
from quakeframe.schema import Catalog
from quakeframe.sources import csv_catalog
from tests.test_relocation import KM, synthetic

NEAR = neighbours.Selection(max_km=10, min_neighbours=4, max_neighbours=20)
FREQ = 200.0


def with_traces(spark, cat, seed=3, noise_s=0.08):
    """Picks that are wrong by some hundredths of a second, and traces in which each true arrival is the same wavelet."""
    rng = np.random.default_rng(seed)
    ph = cat.phases.toPandas()
    t = np.arange(600) / FREQ - 1.5
    error = rng.uniform(-noise_s, noise_s, len(ph))
    traces = []
    for k, r in enumerate(ph.itertuples()):
        wave = np.exp(-((t / 0.08) ** 2)) * np.sin(2 * np.pi * 7 * t + 0.5)
        traces.append((k, r.station_id, "Z", int(r.t_us) - 1_500_000, FREQ, (wave + rng.normal(0, 0.002, len(t))).tolist()))
    ph["t_us"] = ph.t_us + np.rint(error * 1e6).astype(np.int64)
    ph["channel"] = "HHZ"
    return Catalog(cat.stations, cat.events, spark.createDataFrame(ph)), spark.createDataFrame(traces, "trace_id long, station_id string, component string, start_us long, sfreq double, samples array<double>")


def spread(got, true):
    """rms of what events have moved against each other, in km."""
    g = got.set_index("event_id").sort_index()
    d = np.stack([(g.latitude - true[:, 0]) * KM, (g.longitude - true[:, 1]) * KM * np.cos(np.radians(46.5)), g.depth - true[:, 2]], 1)
    return np.sqrt(((d - d.mean(axis=0)) ** 2).sum(axis=1).mean())


@pytest.fixture(scope="module")
def cloud(spark):
    cat, true, t0 = synthetic(spark, 46.5, 8.0, n=16)
    return cat, true, t0


@pytest.mark.parametrize("method", ["LSMR", "LSQR"])
def test_lags_make_up_for_wrong_picks(spark, cloud, method):
    cat, true, _ = cloud
    wrong, traces = with_traces(spark, cat)
    picks = catalog.with_processing(wrong, ["P"], ["S"], [0.0, 0.1]).withColumn("travel_time", F.lit(0.0))
    o = relocate.Options(solver=method, selection=NEAR, xcorr_scaler=2.0)
    cache = relocate.refine(wrong, picks, traces, o, xcorr.XcorrOptions()).persist()
    assert cache.where("valid and coefficient > 0.95").count() == cache.count() > 500
    without = relocate.relocate_catalog(wrong, picks, o).toPandas()
    with_lags = relocate.relocate_catalog(wrong, picks, o, cache).toPandas()
    assert spread(with_lags, true) < 0.06 and spread(with_lags, true) < spread(without, true) / 2  # a sample is 5 ms, some 30 m


def test_lags_are_those_of_the_errors(spark):
    """Gates, codes, components, trusted picks, traces that are missing, and pairs that are known already."""
    st = spark.createDataFrame([("S", 46.5, 8.1, 0.0)], "id string, latitude double, longitude double, elevation double")
    ev = spark.createDataFrame([(k, 46.5, 8.0 + k / 1000, 5.0) for k in range(5)], "id long, latitude double, longitude double, depth double")
    rows = [(0, "HHZ", 0.0), (1, "HHZ", 0.05), (2, "BHZ", 0.0), (3, "HHZ", 0.1), (4, "HHZ", 0.0)]
    picks = spark.createDataFrame([(k, "S", "P", "P", c, 10_000_000 * (k + 1) + round(e * 1e6), 0.0, k != 3) for k, c, e in rows], "event_id long, station_id string, type string, group string, channel string, t_us long, travel_time double, trusted boolean")
    t = np.arange(800) / FREQ - 2.0
    wave = (np.exp(-((t / 0.08) ** 2)) * np.sin(2 * np.pi * 7 * t)).tolist()
    traces = spark.createDataFrame([(k, "S", "Z", 10_000_000 * (k + 1) - 2_000_000, FREQ, wave) for k in range(4)], "trace_id long, station_id string, component string, start_us long, sfreq double, samples array<double>")
    edges = spark.createDataFrame([(a, b, "S", "P") for a, b in ((0, 1), (0, 2), (0, 3), (0, 4), (1, 3))], "ref_id long, neigh_id long, station_id string, type string")
    got = {(r.ev1, r.ev2): r for r in xcorr.correlate_edges(edges, picks, ev, st, traces, xcorr.XcorrOptions(components=("N", "Z"))).collect()}
    assert {k for k, r in got.items() if r.valid} == {(0, 1), (0, 3), (1, 3)} and set(got) <= {(0, 1), (0, 2), (0, 3), (0, 4), (1, 3)}
    for a, b, lag in ((0, 1, -0.05), (0, 3, -0.1), (1, 3, -0.05)):
        assert abs(got[a, b].lag - lag) <= 1.5 / FREQ and got[a, b].coefficient > 0.99
    far = xcorr.correlate_edges(edges, picks, ev, st, traces, xcorr.XcorrOptions(max_event_km=0.1)).where("ev1 = 0 and ev2 = 3")
    assert far.where("valid").isEmpty() and xcorr.correlate_edges(edges, picks, ev, st, traces, xcorr.XcorrOptions(min_station_km=50)).where("valid").isEmpty()
    known = spark.createDataFrame([(0, 1, "S", "P", False, None, None)], "ev1 long, ev2 long, station_id string, type string, valid boolean, coefficient double, lag double")
    again = {(r.ev1, r.ev2): r.valid for r in xcorr.correlate_edges(edges, picks, ev, st, traces, xcorr.XcorrOptions(), known).collect()}
    assert again[0, 1] is False and again[1, 3]


@pytest.mark.parametrize("component", ["R", "T", "L2"])
def test_turned_components_and_rates(spark, component):
    """Motion that only R, only T, or only the length of N and E shows alike for two events in different directions; one trace has half the rate."""
    st = spark.createDataFrame([("S", 46.5, 8.0, 0.0)], "id string, latitude double, longitude double, elevation double")
    places = [(46.52, 8.0), (46.5, 8.03), (46.49, 7.98)]
    ev = spark.createDataFrame([(k, *p, 5.0) for k, p in enumerate(places)], "id long, latitude double, longitude double, depth double")
    shift = [0.0, 0.05, -0.1]
    picks = spark.createDataFrame([(k, "S", "P", "P", "HHZ", 10_000_000 * (k + 1) + round(s * 1e6), 0.0) for k, s in enumerate(shift)], "event_id long, station_id string, type string, group string, channel string, t_us long, travel_time double")
    rng, traces = np.random.default_rng(3), []
    for k, (lat, lon) in enumerate(places):
        f = FREQ / 2 if k == 1 else FREQ
        t = np.arange(int(4 * f)) / f - 2.0
        wave = np.exp(-((t / 0.08) ** 2)) * np.sin(2 * np.pi * 7 * t)
        noise = 0.3 * np.exp(-((t / 0.2) ** 2)) * np.sin(2 * np.pi * rng.uniform(2, 9) * t + rng.uniform(0, 6))
        f1, f2, dl = np.radians(46.5), np.radians(lat), np.radians(lon - 8.0)
        back = np.arctan2(np.sin(dl) * np.cos(f2), np.cos(f1) * np.sin(f2) - np.sin(f1) * np.cos(f2) * np.cos(dl))
        radial, transverse = (wave, noise) if component == "R" else (noise, wave) if component == "T" else (wave * np.cos(k), wave * np.sin(k))
        north, east = -radial * np.cos(back) + transverse * np.sin(back), -radial * np.sin(back) - transverse * np.cos(back)
        traces += [(2 * k + i, "S", c, 10_000_000 * (k + 1) - 2_000_000, f, x.tolist()) for i, (c, x) in enumerate((("N", north), ("E", east)))]
    traces = spark.createDataFrame(traces, "trace_id long, station_id string, component string, start_us long, sfreq double, samples array<double>")
    edges = spark.createDataFrame([(0, 1, "S", "P"), (0, 2, "S", "P"), (1, 2, "S", "P")], "ref_id long, neigh_id long, station_id string, type string")
    o = xcorr.XcorrOptions(components=(component,), resample_hz=FREQ)
    got = {(r.ev1, r.ev2): r for r in xcorr.correlate_edges(edges, picks, ev, st, traces, o).collect()}
    for a, b in got:
        assert got[a, b].valid and got[a, b].coefficient > 0.97 and abs(got[a, b].lag - (shift[a] - shift[b])) <= 1.5 / FREQ
    alone = {(r.ev1, r.ev2): r.valid for r in xcorr.correlate_edges(edges, picks, ev, st, traces, replace(o, resample_hz=0.0)).collect()}
    assert alone == {(0, 1): False, (0, 2): True, (1, 2): False}
    other = {(r.ev1, r.ev2): r.valid for r in xcorr.correlate_edges(edges, picks, ev, st, traces.where("component = 'N'"), replace(o, components=(component, "N"))).collect()}
    assert set(other.values()) == {True}  # without E the next component counts


def test_phase_groups_have_options_of_their_own(spark):
    """P by Z and S by the length of the horizontal motion, with windows and delays of each."""
    st = spark.createDataFrame([("S", 46.5, 8.1, 0.0)], "id string, latitude double, longitude double, elevation double")
    ev = spark.createDataFrame([(k, 46.5, 8.0 + k / 1000, 5.0) for k in range(2)], "id long, latitude double, longitude double, depth double")
    at = {(0, "P"): 0.0, (1, "P"): 0.2, (0, "S"): 0.0, (1, "S"): 0.2}
    picks = spark.createDataFrame([(e, "S", g, g, "HHZ", 20_000_000 * (e + 1) + (3_000_000 if g == "S" else 0) + round(s * 1e6), 4.0) for (e, g), s in at.items()], "event_id long, station_id string, type string, group string, channel string, t_us long, travel_time double")
    t = np.arange(2000) / FREQ - 4.0
    wave = lambda t, f: np.exp(-((t / 0.08) ** 2)) * np.sin(2 * np.pi * f * t)
    traces = [(3 * e + i, "S", c, 20_000_000 * (e + 1) - 4_000_000, FREQ, x.tolist()) for e in range(2) for i, (c, x) in enumerate((("Z", wave(t, 7)), ("N", wave(t - 3, 5)), ("E", wave(t - 3, 5) / 2)))]
    traces = spark.createDataFrame(traces, "trace_id long, station_id string, component string, start_us long, sfreq double, samples array<double>")
    edges = spark.createDataFrame([(0, 1, "S", "P"), (0, 1, "S", "S")], "ref_id long, neigh_id long, station_id string, type string")
    got = {r.type: r for r in xcorr.correlate_edges(edges, picks, ev, st, traces, presets.LIBRARY_XCORR).collect()}
    assert all(got[g].valid and got[g].coefficient > 0.97 and abs(got[g].lag + 0.2) <= 1.5 / FREQ for g in "PS")
    tight = tuple((g, replace(p, max_delay=0.1 if g == "S" else 0.5)) for g, p in presets.PHASES)
    got = {r.type: r for r in xcorr.correlate_edges(edges, picks, ev, st, traces, xcorr.XcorrOptions(by_phase=tight)).collect()}
    assert abs(got["P"].lag + 0.2) <= 1.5 / FREQ and abs(got["S"].lag) <= 0.1
    assert presets.APPLICATION_SINGLE.selection.max_neighbours == 80 and presets.APPLICATION_MULTI.selection.in_nearest_mode and not presets.LIBRARY_SELECTION.in_nearest_mode


def test_a_table_of_travel_times(spark, cloud):
    cat, true, _ = cloud
    picks = catalog.with_processing(cat, ["P"], ["S"], [0.0, 0.1])
    d, z = np.meshgrid(np.arange(0, 61, 0.5), np.arange(-4, 16, 0.5), indexing="ij")
    table = pd.concat([pd.DataFrame({"group": g, "distance_km": d.ravel(), "depth_km": z.ravel(), "travel_time": np.hypot(d, z).ravel() / v}) for g, v in (("P", 5.8), ("S", 3.36))])
    flat = Catalog(cat.stations.withColumn("elevation", F.lit(0.0)), cat.events, cat.phases)
    straight = relocate.relocate_catalog(flat, picks, relocate.Options(selection=NEAR, omega=(0.3, 0.3))).toPandas().set_index("event_id")
    tabled = relocate.relocate_catalog(flat, picks, relocate.Options(selection=NEAR, omega=(0.3, 0.3), times=relocate.table_times(table))).toPandas().set_index("event_id")
    assert abs(straight.latitude - tabled.latitude).max() * KM < 0.05 and abs(straight.depth - tabled.depth).max() < 0.15
    low = table[table.depth_km >= 6]  # events above it have no times, and none may move there
    cut = relocate.relocate_catalog(flat, picks, relocate.Options(selection=NEAR, times=relocate.table_times(low))).toPandas()
    before = flat.events.toPandas().set_index("id").depth
    assert (cut.depth[cut.event_id.map(before) >= 6] >= 6).all() and (cut.depth[cut.event_id.map(before) < 6] == cut.event_id.map(before)[cut.event_id.map(before) < 6]).all()


def test_phases_and_differences(spark, cloud, tmp_path):
    cat, _, _ = cloud
    picks = catalog.with_processing(cat, ["P"], ["S"], [0.0, 0.1])
    o = relocate.Options(selection=NEAR, omega=(0.3, 0.3), alpha=(6.0, 6.0))
    obs = relocate.catalog_observations(cat, picks, o).persist()
    phases = relocate.relocate(obs, o, result=relocate.PHASES).toPandas()
    events = relocate.relocate(obs, o).toPandas().set_index("event_id")
    assert len(phases) == cat.phases.count() and phases.used.all()
    rms = phases.assign(x=phases.final_residual**2).groupby("event_id").x.mean() ** 0.5
    assert np.allclose(rms, events.final_rms.loc[rms.index]) and (events.stopped == solver.SOLVED).all()
    diff = relocate.relocate(obs, o, result=relocate.DIFFERENCES)
    assert diff.count() == obs.count() and diff.where("abs(residual) > 0.01 or distance > 10.5").isEmpty()
    named = Catalog(cat.stations.withColumns({"network": F.lit("N"), "station": F.split("id", "[.]")[1], "location": F.lit("")}), cat.events, cat.phases)
    csv_catalog.write_differences(diff, named.stations, str(tmp_path / "dd"))
    back = csv_catalog.read_csv(spark, str(tmp_path / "dd"))
    assert back.count() == diff.count() and {"doubleDifferenceResidual", "xcorrUsed", "interEventDistance"} <= set(back.columns)


@pytest.mark.parametrize("method", ["LSMR", "LSQR"])
def test_large_clusters_give_the_same(spark, method):
    """Events, phases and differences, with one event that has no weight and one that a move leaves without travel times."""
    cat, _, _ = synthetic(spark, 46.5, 8.0, n=6)
    cat = Catalog(cat.stations, cat.events, cat.phases.withColumns({c: F.when(F.col("event_id") == 3, 9.0).otherwise(F.col(c)) for c in ("lower_unc", "upper_unc")}))
    picks = catalog.with_processing(cat, ["P"], ["S"], [0.0, 0.1]).withColumn("class_weight", F.when(F.col("event_id") == 3, 0.0).otherwise(F.col("class_weight")))
    o = relocate.Options(iterations=1, solver=method, damping=(0.5, 0.5), omega=(0.5, 0.5), alpha=(6.0, 6.0), selection=replace(NEAR, max_neighbours=3, min_neighbours=2))
    obs = relocate.catalog_observations(cat, picks, o).where("ref_id <> 3 and neigh_id <> 3 or type = 'P'").withColumn("class_weight1", F.when(F.greatest("ref_id", "neigh_id") == 3, 0.0).when(F.least("ref_id", "neigh_id") == 3, 0.0).otherwise(F.col("class_weight1")))
    obs = obs.withColumn("class_weight2", F.when((F.col("ref_id") == 3) | (F.col("neigh_id") == 3), 0.0).otherwise(F.col("class_weight2"))).persist()
    keys = {relocate.RESULT: ["event_id"], relocate.PHASES: ["event_id", "station_id", "type"], relocate.DIFFERENCES: ["ref_id", "neigh_id", "station_id", "type"]}
    for result, by in [x for k, x in enumerate(keys.items()) if k != (1 if method == "LSQR" else 2)]:
        small, large = (relocate.relocate(obs, replace(o, most_rows=n), result=result).toPandas().sort_values(by).set_index(by) for n in (10_000, 10))
        assert list(small) == list(large) and len(small) == len(large) > 5
        for c in small:
            if small[c].dtype == float:
                assert np.allclose(small[c], large[c], atol=1e-5, equal_nan=True), c
            elif c == "t_us":
                assert abs(small.t_us - large.t_us).max() <= 20
            else:
                assert (small[c] == large[c]).all(), c
        if result == relocate.RESULT:
            assert not small.moved[3] and small.moved.drop(3).all() and set(large.stopped) == {solver.SOLVED}
    assert not spark.catalog.listTables()


def two_events(cat, spark, o, lost=None, n=3):
    """An observation table of three events, and travel times that some stations (numbers) lose once an event moves."""
    ids = list(range(n))
    few = Catalog(cat.stations, cat.events.where(F.col("id").isin(ids)), cat.phases.where(F.col("event_id").isin(ids)))
    picks = catalog.with_processing(few, ["P"], ["S"], [0.0, 0.1])
    obs = relocate.catalog_observations(few, picks, o)
    start = {tuple(r) for r in few.events.select("latitude", "longitude", "depth").collect()}
    plain = relocate.straight_rays(5.8, 3.36)
    elevations = sorted(r.elevation for r in cat.stations.collect())

    def times(lat, lon, depth, station, group):
        tt, slope = plain(lat, lon, depth, station, group)
        here = np.array([p in start for p in zip(lat, lon, depth, strict=True)], bool)
        gone = np.isin(np.searchsorted(elevations, station[:, 2]), lost or []) & ~here
        return np.where(gone, np.nan, tt), slope

    return few, obs, times


@pytest.mark.parametrize("most_rows", [10_000, 1])
def test_one_lost_phase_holds_no_event_back(spark, cloud, most_rows):
    """The phase isn't used any more; only events without any travel time go back."""
    o = relocate.Options(iterations=2, most_rows=most_rows, damping=(0.3, 0.3), selection=replace(NEAR, min_neighbours=1))
    few, obs, times = two_events(cloud[0], spark, o, lost=[2])
    got = relocate.relocate(obs, replace(o, times=times)).toPandas()
    before = few.events.toPandas().set_index("id").depth
    assert got.moved.all() and (got.depth != got.event_id.map(before)).all() and got.final_rms.notna().all()
    few, obs, times = two_events(cloud[0], spark, o, lost=list(range(8)))
    got = relocate.relocate(obs, replace(o, times=times)).toPandas()
    as_ref = {r[0] for r in obs.select("ref_id").distinct().collect()}
    for r in got.itertuples():
        assert r.moved == (r.event_id not in as_ref) and (r.moved or r.depth == before[r.event_id])


@pytest.mark.parametrize("most_rows", [10_000, 1])
def test_without_weight_no_event_moves(spark, cloud, tmp_path, most_rows):
    o = relocate.Options(iterations=2, most_rows=most_rows, selection=replace(NEAR, min_neighbours=1))
    few, obs, _ = two_events(cloud[0], spark, o)
    got = relocate.relocate(obs.withColumns({c: F.lit(0.0) for c in ("class_weight1", "class_weight2")}), o)
    assert not got.toPandas().moved.any() and relocate.only_moved(got).isEmpty() and got.select("stopped").distinct().collect() == [(solver.ZERO,)]
    assert rebuild.moved(few.events, got).where("relocated").isEmpty()


def test_a_badly_conditioned_system_is_rejected():
    a = np.diag([1.0, 1e-9])
    for f in (solver.lsmr, solver.lsqr):
        _, stopped = f(lambda x: a @ x, lambda y: a.T @ y, np.array([1.0, 1.0]), 2, 0.0, 1e-16)
        assert stopped == solver.CONDITION


def test_two_steps_and_versions(spark, tmp_path):
    cat, true, t0 = synthetic(spark, 46.5, 8.0, seed=4)
    events = cat.events.toPandas()
    for i, c in enumerate(("latitude", "longitude", "depth")):
        events.loc[events.id != 5, c] = true[events.id != 5, i]
    events.loc[events.id != 5, "t_us"] = t0[events.id != 5]
    ev = spark.createDataFrame(events)
    old = Catalog(cat.stations, ev.where("id <> 5"), cat.phases.where("event_id <> 5"))
    new = Catalog(cat.stations, ev.where("id = 5"), cat.phases.where("event_id = 5"))
    picks = catalog.with_processing(Catalog(cat.stations, ev, cat.phases), ["P"], ["S"], [0.0, 0.1])
    o = relocate.Options(selection=replace(NEAR, shells=3))
    one = relocate.relocate_single(old, new, picks, replace(o, selection=replace(o.selection, min_ratio=1.0))).collect()[0]
    two = relocate.relocate_in_two_steps(old, new, picks, o).collect()
    assert [r.event_id for r in two] == [5] and two[0].start_rms == one.start_rms and two[0].final_rms < one.start_rms / 10
    assert abs(two[0].latitude - true[5, 0]) * KM < 0.01 and abs(two[0].depth - true[5, 2]) < 0.05
    path = str(tmp_path / "reference")
    assert rebuild.publish(old, path) == 1
    got = rebuild.relocating(path, lambda e: cat.phases.join(e.select(F.col("id").alias("event_id")), "event_id", "left_semi"), o, ["P"], ["S"], [0.0, 0.1])(new.events).collect()
    assert [r.event_id for r in got] == [5] and abs(got[0].latitude - two[0].latitude) < 1e-6
    assert rebuild.rebuild(rebuild.current(spark, path), path, relocate.Options(iterations=2, selection=NEAR), ["P"], ["S"], [0.0, 0.1]) == 2
    assert rebuild.versions(spark, path) == [1, 2] and rebuild.current(spark, path).events.where("relocated").count() == 29
    with pytest.raises(ValueError):
        rebuild.current(spark, path, 9)


def test_neighbours_below_reach_twice_as_far(spark):
    """Ellipsoids are twice as long down as across."""
    st = spark.createDataFrame([(f"S{k}", 46.5 + k / 10, 8.2, 0.0) for k in range(4)], "id string, latitude double, longitude double, elevation double")
    ev = spark.createDataFrame([(1, 46.5, 8.0, 3.0), (2, 46.5, 8.0, 10.0), (3, 46.56, 8.0, 3.0)], "id long, latitude double, longitude double, depth double")
    ph = spark.createDataFrame([(e, f"S{k}", "P", 0) for e in (1, 2, 3) for k in range(4)], "event_id long, station_id string, type string, t_us long")
    o = neighbours.Selection(max_km=5.0, min_neighbours=1, max_neighbours=5, min_phases=4, shells=3)
    pairs = lambda o: {(r.ref_id, r.neigh_id) for r in neighbours.select_neighbours(Catalog(st, ev, ph), o).collect()}
    assert pairs(o) == {(1, 2), (2, 1)} and pairs(replace(o, shells=0)) == set() and pairs(replace(o, max_neighbours=0)) == set()
