"""Work that grows with the rows, not with all pairs of rows that lie near each other: most rows that any step of a plan gives."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quakeframe import queries
from quakeframe.operators import joins, neighbours, spatial, stats
from quakeframe.schema import Catalog


def most_rows(spark, run) -> int:
    """The most rows that one operator gave in the queries that ``run`` starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())}
    before = ids()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for e in ids() - before:
        values, metrics = store.executionMetrics(e), store.execution(e).get().metrics()
        for k in range(metrics.size()):
            m = metrics.apply(k)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "").split("\n")[-1].split(" ")[0]))
    return most


def points(spark, n: int, wide: float) -> pd.DataFrame:
    rng = np.random.default_rng(3)
    return pd.DataFrame({"id": np.arange(n), "latitude": 46.8 + wide * rng.random(n), "longitude": 8.4 + wide * rng.random(n), "depth": 2 + 3 * rng.random(n)})


def test_events_without_common_picks_do_not_meet(spark):
    """1500 events within a km of each other, with picks of ten stations for each thirty: 2 million pairs are near, 43,500 share picks."""
    ev = points(spark, 1500, 0.005)
    ph = pd.DataFrame([(e, f"S{e // 30 * 10 + k}", "P") for e in range(1500) for k in range(10)], columns=["event_id", "station_id", "type"])
    st = pd.DataFrame({"id": [f"S{k}" for k in range(500)], "latitude": 46.9, "longitude": 8.5, "elevation": 500.0})
    cat = Catalog(spark.createDataFrame(st), spark.createDataFrame(ev), spark.createDataFrame(ph))
    for o in (neighbours.Selection(), neighbours.Selection(shells=2)):
        got = []
        assert most_rows(spark, lambda: got.extend(neighbours.eligible_edges(cat, o).groupBy("ref_id", "neigh_id").count().collect())) < 1_000_000
        assert {(r.ref_id, r.neigh_id) for r in got} == {(a, b) for a in range(1500) for b in range(a // 30 * 30, a // 30 * 30 + 30) if a != b}
        assert {r["count"] for r in got} == {10}


def test_nearest_within_are_the_first_of_all(spark):
    df = spark.createDataFrame(points(spark, 1500, 0.03)).repartition(4)
    want = {(r.ref_id, r.neigh_id) for r in neighbours.nearest_first(spatial.neighbours_within(df, 1.0), 3).collect()}
    got = []
    assert most_rows(spark, lambda: got.extend(spatial.nearest_within(df, 1.0, 3).collect())) < 300_000
    assert {(r.ref_id, r.neigh_id) for r in got} == want and len(want) == len(got) > 4000


def test_shells_within_are_those_of_all_pairs(spark):
    """1200 events of which all pairs are near: most choices are settled within a small part of the innermost shell. Fewer shells and more
    neighbours need later turns."""
    df = spark.createDataFrame(points(spark, 1200, 0.06)).repartition(4).cache()
    for o in (neighbours.Selection(max_neighbours=8, shells=3), neighbours.Selection(max_km=0.6, max_neighbours=30, shells=2)):
        want = set(map(tuple, neighbours.by_shells(spatial.neighbours_within(df, 2 * o.max_km), df, o).drop("distance").collect()))
        got = []
        most = most_rows(spark, lambda: got.extend(neighbours.shells_within(df, o).drop("distance").collect()))
        assert set(map(tuple, got)) == want and len(got) == len(want) > 4000
        if o.shells == 3:
            assert most < 600_000


def test_nearest_from_far_below_looks_at_few(spark):
    """Stations on a plain and events below them: what is asked of a row is a thin layer of stations, not all within its depth."""
    st = points(spark, 3000, 0.2).assign(depth=lambda d: d.id % 100 / -100.0)
    ev = points(spark, 400, 0.2).assign(depth=lambda d: 5.0 + d.id % 7)
    a, b = spark.createDataFrame(ev), spark.createDataFrame(st)
    got = []
    assert most_rows(spark, lambda: got.extend(spatial.nearest(a, b, 2).collect())) < 100_000
    d = spatial.radius_pairs(a, b, 60.0).toPandas().sort_values(["a_id", "distance", "b_id"]).groupby("a_id").head(2)
    assert {(r.a_id, r.b_id) for r in got} == set(zip(d.a_id, d.b_id, strict=True)) and len(got) == 800


def test_many_short_runs_are_folded_without_a_frame_each(spark, capsys):
    """Windows of 2000 keys: each key by itself is too small for a group of its own."""
    df = spark.range(20_000).selectExpr("id % 2000 as k", "(id div 2000) * 100 as start_us", "(id div 2000) * 100 + if(id % 2 = 0, 100, 50) as end_us")
    found = joins.merge_growing(df, ["k"], 0.1, 300)
    found.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
    assert sorted(map(tuple, found.groupBy(F.col("k") % 2, "n").count().collect())) == [(0, 10, 1000), (1, 1, 10_000)]


def test_windows_are_merged_in_all_parts(spark):
    """Few bytes are one part after a shuffle unless their number of parts is asked for."""
    df = spark.range(4000).selectExpr("id % 400 as k", "(id div 400) * 100 as start_us", "(id div 400) * 100 + if(id % 2 = 0, 100, 50) as end_us")
    found = joins.merge_requests(df, ["k"], 10, slice_us=300)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert sorted(map(tuple, found.groupBy(F.col("k") % 2, "n").count().collect())) == [(0, 10, 200), (1, 1, 2000)]


def test_stations_are_counted_without_copies_of_arrivals(spark):
    df = spark.range(30_000).selectExpr("id % 1000 as event_id", "concat('S', id % 7) as station_id", "id % 3 = 0 as used", "cast(id % 11 as double) as distance", "1e0 as residual")
    got = []
    assert most_rows(spark, lambda: got.extend(stats.origin_quality(df).collect())) <= 30_000
    want = df.groupBy("event_id").agg(F.count_distinct("station_id"), F.count_distinct(F.when(F.col("used"), F.col("station_id"))))
    assert {(r.event_id, r.stations, r.used_stations) for r in got} == set(map(tuple, want.collect()))


def test_bins_are_counted_not_ranked(spark, monkeypatch):
    """50,000 rows of which few lie in a step that a bin's edge cuts; with one step for all, or equal distances, all are ranked one by one."""
    sizes, ranked = [], stats.ranked
    monkeypatch.setattr(stats, "ranked", lambda df, *a: sizes.append(df.count()) or ranked(df, *a))
    rows = spark.range(50_000).selectExpr("cast(id * 7919 % 10007 as double) / 1e3 as d", "if(id % 50 = 0, null, id * 31 % 101) as v", "id as o")
    for df, step in ((rows, 1e-2), (rows, 1e3), (rows.withColumn("d", F.lit(2.0)), 1e-2)):
        sizes.clear()
        got = stats.binned_residuals(df, "d", "v", 20, ["o"], step=step).collect()
        assert (max(sizes) < 10_000) == (df is rows and step < 1)
        p = df.toPandas().sort_values(["d", "o"])
        p["bin"] = np.arange(len(p)) // (len(p) // 20 + 1)
        for r in got:
            own = p[p.bin == r.bin]
            v = np.sort(own.v.dropna().to_numpy())
            n = len(v)
            assert (r.n, r.min, r.q1, r.q2, r.q3, r.max, r["from"], r.to) == (n, v[0], v[n // 4], v[n // 2], v[n // 4 + n // 2], v[-1], own.d.min(), own.d.max())
        assert len(got) == 20


def test_projections_are_worked_out_once_before_the_inverses(spark, capsys):
    queries.queries()["map_projections"](spark, "/root/testdata/sf0.001").explain()
    assert "hashpartitioning(id" in capsys.readouterr().out


def shuffled(df) -> int:
    """Rows that the exchanges of a plan which has run wrote."""
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        if (name := p.getClass().getSimpleName()) == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if name == "ShuffleExchangeExec":
            rows += p.longMetric("shuffleRecordsWritten").value()
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return rows


def kms(p: pd.DataFrame) -> np.ndarray:
    """Distances of all rows of ``points``, as ``geo.distance3d`` has them."""
    f, l0, d = np.radians(p.latitude.to_numpy()), np.radians(p.longitude.to_numpy()), p.depth.to_numpy()
    a = np.sin((f[:, None] - f) / 2) ** 2 + np.cos(f)[:, None] * np.cos(f) * np.sin((l0[:, None] - l0) / 2) ** 2
    return np.hypot(2 * np.arcsin(np.sqrt(np.clip(a, 0, 1))) * (6371.00877141506 - (d[:, None] + d) / 2), d[:, None] - d)


def test_pairs_of_one_table_are_those_of_brute_force(spark):
    """Rows around a pole, across the date line, at crossings of the axes, in a swarm that one cell holds, and anywhere; some ids are there twice."""
    rng = np.random.default_rng(5)
    parts = [(89.9, 0.0, 0.1, 360.0, 40), (46.0, 179.95, 0.1, 0.1, 60), (-0.05, -0.05, 0.1, 0.1, 60), (-0.05, 89.95, 0.1, 0.1, 60), (-33.0, -70.0, 0.01, 0.01, 400), (-80.0, -180.0, 160.0, 360.0, 200)]
    at = np.concatenate([np.column_stack([lat + h * rng.random(n), lon + w * rng.random(n), 10 * rng.random(n)]) for lat, lon, h, w, n in parts])
    ev = pd.DataFrame({"id": rng.permutation(len(at)), "latitude": at[:, 0], "longitude": (at[:, 1] + 180) % 360 - 180, "depth": at[:, 2]})
    ev.loc[ev.index % 50 == 0, "id"] = ev.id.shift(-1, fill_value=0)
    for km in (0.7, 5.0, 30.0, 9000.0):
        d, ids = kms(ev), ev.id.to_numpy()
        i, j = np.nonzero((d <= km) & (ids[:, None] != ids))
        df = spatial.neighbours_within(spark.createDataFrame(ev), km, digits=6)
        got = df.toPandas().sort_values(["ref_id", "neigh_id", "distance"])
        want = pd.DataFrame({"ref_id": ids[i], "neigh_id": ids[j], "distance": d[i, j]}).sort_values(["ref_id", "neigh_id", "distance"])
        assert len(got) == len(want) > 500 and (got[["ref_id", "neigh_id"]].to_numpy() == want[["ref_id", "neigh_id"]].to_numpy()).all()
        assert np.allclose(got.distance, want.distance, atol=1e-5)


def test_pairs_of_one_table_shuffle_few_copies(spark):
    """Of 3,000 rows each was shuffled 29 times before, where no side is small enough to be sent to all."""
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spatial.neighbours_within(spark.createDataFrame(points(spark, 3000, 0.5)), 5.0)
        assert len(df.collect()) > 50_000 and 3000 < shuffled(df) < 36_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_a_crowded_cell_is_split(spark):
    """2,000 rows in one cell: its pairs are made in several parts, with no more rows of copies than the root of the parts."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ev = points(spark, 2000, 0.001)
        df = spatial.neighbours_within(spark.createDataFrame(ev), 1000.0)
        made = df.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert made.sum() == 2000 * 1999 and len(made) > 4 and made.max() < 2000 * 1999 / 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rows_that_share_keys_meet_as_by_brute_force(spark):
    """Rows around a pole, across the date line and in several bands of latitude, some of them twice; an ellipsoid around either end. Rows are shuffled once."""
    rng = np.random.default_rng(8)
    parts = [(89.9, 0.0, 0.1, 360.0, 60), (46.0, 179.95, 0.1, 0.1, 90), (-0.05, -0.05, 0.1, 0.1, 90), (-33.0, -70.0, 3.0, 0.05, 300)]
    at = np.concatenate([np.column_stack([lat + h * rng.random(n), lon + w * rng.random(n), 10 * rng.random(n)]) for lat, lon, h, w, n in parts])
    ev = pd.DataFrame({"id": rng.permutation(len(at)), "latitude": at[:, 0], "longitude": (at[:, 1] + 180) % 360 - 180, "depth": at[:, 2], "key": rng.integers(0, 3, len(at)), "extra": np.arange(len(at)).astype(str)})
    d, ids, key = kms(ev), ev.id.to_numpy(), ev.key.to_numpy()
    near = (ids[:, None] < ids) & (key[:, None] == key)
    z = ev.depth.to_numpy()
    dz = z - z[:, None]
    h = np.sqrt(np.maximum(0.0, d**2 - dz**2)) / (6371.00877141506 - (z[:, None] + z) / 2) * (6371.00877141506 - z[:, None])
    inside = (h / 4.0) ** 2 + (dz / 8.0) ** 2 <= 1.0
    df = spark.createDataFrame(pd.concat([ev, ev[ev.id % 5 == 0]]))
    for km, ellipsoid in ((0.7, None), (8.0, (8.0, 4.0)), (9000.0, None)):
        found = spatial.sharing_within(df, ["key"], km, ["id", "extra"], ellipsoid)
        got = found.toPandas()
        ok = near & (d <= km) & (inside | inside.T if ellipsoid else True)
        i, j = np.nonzero(ok)
        want = pd.DataFrame({"id1": ids[i], "id2": ids[j], "extra1": ev.extra.to_numpy()[i], "extra2": ev.extra.to_numpy()[j], "distance": d[i, j], "in1": inside[i, j], "in2": inside[j, i]}).sort_values(["id1", "id2"])
        got = got.sort_values(["id1", "id2"])
        same = ["id1", "id2", "extra1", "extra2", *(["in1", "in2"] if ellipsoid else [])]
        assert len(got) == len(want) > 4 and (got[same].to_numpy() == want[same].to_numpy()).all() and np.allclose(got.distance, want.distance, atol=1e-5)
        assert shuffled(found) <= 2 * df.count()


def test_pairs_to_be_peeled_are_made_once(spark):
    """Each pair was made three times: to be counted, and for both sides of the first round."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    pairs = spark.range(12).selectExpr("id as ref_id").crossJoin(spark.range(12).selectExpr("id as neigh_id")).where("ref_id <> neigh_id and (ref_id > 0 or neigh_id < 3) and (neigh_id > 0 or ref_id < 3)")
    n = pairs.count()
    left = neighbours.peel(pairs.mapInArrow(seen, pairs.schema), 3, 0)
    assert {(r.ref_id, r.neigh_id) for r in left.collect()} == {(a, b) for a in range(1, 12) for b in range(1, 12) if a != b}
    assert made.value == n


def test_pairs_are_binned_without_a_row_each(spark):
    """1,200 rows around a pole, across the date line and in a swarm: 700,000 pairs and more were as many rows of a join. Few steps have all pairs of a cut step ranked."""
    rng = np.random.default_rng(4)
    parts = [(89.98, 0.0, 0.02, 360.0, 100), (46.0, 179.99, 0.02, 0.02, 200), (-33.0, -70.0, 0.01, 0.01, 900)]
    at = np.concatenate([np.column_stack([lat + h * rng.random(n), lon + w * rng.random(n), 3 * rng.random(n)]) for lat, lon, h, w, n in parts])
    ev = pd.DataFrame({"id": rng.permutation(len(at)), "latitude": at[:, 0], "longitude": (at[:, 1] + 180) % 360 - 180, "depth": at[:, 2]})
    ev.loc[ev.index % 100 == 0, ["latitude", "longitude", "depth"]] = [-33.0, -70.0, 1.0]  # equal places, distances of 0
    df, ids = spark.createDataFrame(ev), ev.id.to_numpy()
    for km, steps in ((5.0, 200_000), (5.0, 30), (60.0, 1000)):
        got = []
        most = most_rows(spark, lambda: got.extend(stats.binned_within(df, km, "v", lambda a, b: (a * 31 + b * 17) % 101, 101, 7, steps).collect()))
        near = spatial.neighbours_within(df, km).toPandas()
        p = near.assign(mm=np.floor(near.distance * 1e6 + 0.5), v=(near.ref_id * 31 + near.neigh_id * 17) % 101).sort_values(["mm", "ref_id", "neigh_id"])
        assert len(p) > 700_000 and len(got) == 7 and set(p.ref_id) <= set(ids)
        assert steps <= 1000 or most < len(p) / 2
        p["bin"] = np.arange(len(p)) // (len(p) // 7 + 1)
        for r in got:
            own = p[p.bin == r.bin]
            v = np.sort(own.v.to_numpy())
            n = len(v)
            assert (r.n, r.min, r.q1, r.q2, r.q3, r.max) == (n, v[0], v[n // 4], v[n // 2], v[n // 4 + n // 2], v[-1])
            assert abs(r["from"] - own.mm.min() / 1e6) < 1e-9 and abs(r.to - own.mm.max() / 1e6) < 1e-9
    assert stats.binned_within(df.limit(0), 5.0, "v", lambda a, b: a * 0, 1, 7).collect() == []
