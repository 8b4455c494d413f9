"""Sliding coefficients by running sums, records to traces, growing windows, and geodesics, against plain code."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeframe.functions import geodesic
from quakeframe.operators import joins, records, waveform


def plain_pearson(short, long):
    out = np.full(len(long) - len(short) + 1, np.nan)
    for k in range(len(out)):
        w = long[k : k + len(short)]
        if np.ptp(w) > 0 and np.ptp(short) > 0:
            a, b = short - short.mean(), w - w.mean()
            out[k] = a @ b / np.sqrt((a @ a) * (b @ b))
    return out


@pytest.mark.parametrize("n,m", [(1, 5), (2, 2), (7, 50), (64, 64), (100, 5000), (33, 40_000)])
def test_running_sums_give_the_same(n, m):
    """Also beside a peak ten million times as high, on an offset, and with flat stretches."""
    rng = np.random.default_rng(n)
    short, long = rng.normal(size=n), rng.normal(size=m) * np.exp(rng.normal(size=m) * 2) + 1e4
    if m > 20:
        long[m // 3 : m // 3 + n + 3] = 5.0
        long[m // 2] += 1e7
    got, want = waveform.sliding_pearson(short, long), plain_pearson(short, long)
    assert (np.isnan(got) == np.isnan(want)).all() and np.nanmax(np.abs(got - want), initial=0) < 1e-9
    both = waveform.sliding_pearson(np.stack([short, short * 0 + 3]), np.stack([long, long[::-1]]))
    assert np.allclose(both[0], got, equal_nan=True, atol=1e-12) and np.isnan(both[1]).all()


def test_pairs_of_all_lengths_in_one_batch(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=rng.integers(0, 40)).tolist(), rng.normal(size=rng.integers(0, 40)).tolist(), float(rng.choice([10.0, 20.0]))) for k in range(200)]
    rows += [(200, [1.0] * 9, [2.0, 3.0, 4.0], 10.0), (201, [1.0, 2.0, 1.0], [5.0] * 9, 10.0)]
    got = {r.id: r for r in waveform.cross_correlate(spark.createDataFrame(rows, "id long, samples1 array<double>, samples2 array<double>, sfreq double"), 0.5).collect()}
    for k, a, b, f in rows:
        cc, lag = waveform.best_lag(np.array(a), np.array(b), f, 0.5)
        assert got[k].valid == (cc is not None) and (cc is None or abs(got[k].coefficient - cc) < 1e-12 and got[k].lag == lag)
    assert not got[200].valid and not got[201].valid and sum(r.valid for r in got.values()) > 150


def plain_traces(rows):
    """(stream, rate, segment): start and samples."""
    out, state = {}, {}
    for key, start, f, x in sorted(((k, s, f, x) for k, s, f, x in rows if x and f > 0), key=lambda r: (r[0], r[2], r[1], -len(r[3]), r[3])):
        at = state.get((key, f))
        if at is None or start > at[1] + 0.5e6 / f:
            n = (at[0] if at else 0) + 1
            out[key, f, n], cut, reach = [start, []], 0, at[1] if at else start
        else:
            n, reach = at
            cut = max(0, int(np.floor((reach - start) * f / 1e6 + 0.5)))
        out[key, f, n][1] += x[cut:]
        state[key, f] = (n, max(reach, start + round(len(x) * 1e6 / f)))
    return out


def test_records_over_days_and_stretches(spark):
    """Overlaps, repeats, gaps, records inside others, small shifts, two rates, empty and null ones, and a stream of three days."""
    rng = np.random.default_rng(2)
    rows, day = [], 86_400_000_000
    for key in ("a", "b", "c"):
        t = 1_600_000_000_000_000 // 10_000 * 10_000
        for _ in range(60):
            n = int(rng.integers(1, 400))
            f = 100.0 if key != "c" or rng.random() < 0.5 else 50.0
            rows.append((key, t, f, rng.integers(0, 1000, n).astype(float).tolist()))
            if rng.random() < 0.2:
                rows.append(rows[-1])
            step = rng.choice([0, 0, 0, -5, -300, 1, 50, 20_000], p=[0.3, 0.2, 0.1, 0.1, 0.05, 0.1, 0.1, 0.05])
            t += max(0, int(n * 1e6 / f) + int(step) * 20_000) + (day // 7 // 10_000 * 10_000 if key == "b" and rng.random() < 0.3 else 0)
    df = spark.createDataFrame([*rows, ("a", 0, 100.0, []), ("a", 0, 0.0, [1.0]), (None, 0, 100.0, [1.0, 2.0])], "k string, start_us long, sfreq double, samples array<double>").repartition(3)
    pieces = records.assembled(df, ["k"], stretch_us=2_000_000)
    got = {}
    for r in pieces.where("k is not null").orderBy("k", "sfreq", "segment", "start_us").collect():
        own = got.setdefault((r.k, r.sfreq, r.segment), [r.start_us, []])
        late = r.start_us - own[0] - round(len(own[1]) * 1e6 / r.sfreq)  # records may be half a sample off, one after the other
        assert abs(late) <= (0 if r.sfreq == 100 else 60 * 10_000) and r.stretch == r.start_us // 2_000_000 and r.end_us == r.start_us + round(len(r.samples) * 1e6 / r.sfreq)
        own[1] += r.samples
    assert got == plain_traces(rows) and len(got) > 12
    assert records.assembled(df.where("false"), ["k"]).count() == 0


def test_windows_of_records(spark):
    x = [float(i) for i in range(1000)]
    rows = [("s", i * 10_000, 100.0, x[i : i + 100]) for i in (*range(0, 500, 100), *range(520, 1000, 100))]
    pieces = records.assembled(spark.createDataFrame(rows, "k string, start_us long, sfreq double, samples array<double>"), ["k"], stretch_us=1_500_000)
    ask = [(1, "s", 1_234_000, 3_456_000), (2, "s", 1_000_000, 9_000_000), (3, "s", 4_900_000, 5_300_000), (4, "s", 9_900_000, 10_020_000), (5, "t", 0, 10), (6, "s", 20_000_000, 21_000_000), (7, "s", -10_000, 1_000_000), (8, "s", 0, 4_990_000)]
    got = {r.request_id: r for r in records.loaded(spark.createDataFrame(ask, "request_id long, k string, start_us long, end_us long"), pieces, ["k"], stretch_us=1_500_000).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "gaps", 3: "low_availability", 4: "low_availability", 5: "no_data", 6: "no_data", 7: "short", 8: "ok"}
    assert got[1].samples == x[123:347] and got[1].trace_start_us == 1_230_000 and got[8].samples == x[:500] and got[7].samples is None


def test_growing_windows_do_not_depend_on_slices(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(a), int(a + b)) for k, a, b in zip(rng.integers(0, 3, 600).tolist(), rng.integers(0, 60_000, 600), rng.integers(0, 300, 600), strict=True)]
    df = spark.createDataFrame(rows, "k long, start_us long, end_us long")
    want = []
    for k in range(3):
        run = None
        for a, b in sorted((a, b) for key, a, b in rows if key == k):
            if run and a <= run[2] + 0.1 * (run[2] - run[1]):
                run[2:] = [max(run[2], b), run[3] + 1]
            else:
                run = [k, a, b, 1]
                want.append(run)
    for slice_us in (10**9, 5000, 137):
        assert sorted(map(list, joins.merge_growing(df, ["k"], 0.1, slice_us).collect())) == sorted(want)
    assert 20 < len(want) < 400 and joins.merge_growing(df.where("false"), ["k"]).count() == 0


def test_geodesics(spark):
    """Published lines, poles, meridians and the equator, and points opposite each other."""
    cases = [
        (50.06632, -5.71475, 58.64402, -3.07009, 969954.166),  # Land's End to Duncansby Head
        (-37.95103, 144.42487, -37.65282, 143.92650, 54972.271),  # Flinders Peak to Buninyong, on WGS84
        (0.0, 0.0, 0.0, 90.0, np.pi * geodesic.A / 2),
        (0.0, 0.0, 90.0, 0.0, 10001965.729),
        (10.0, 179.5, 10.0, -179.5, None),
        (10.0, 0.0, 10.0, 0.0, 0.0),
        (0.0, 0.0, 0.0, 180.0, 20003931.459),  # over a pole, as that is shorter
        (90.0, 0.0, -90.0, 77.0, 20003931.459),
        (30.0, 0.0, -30.0, 180.0, 20003931.459),
        (0.0, 0.0, 0.5, 179.7, 19944127.421),
    ]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)] + [(99, None, 0.0, 0.0, 0.0)], "k long, a double, b double, c double, d double")
    got = {r.k: r.m for r in df.select("k", geodesic.geodesic_m(*[F.col(c) for c in "abcd"]).alias("m")).collect()}
    for k, c in enumerate(cases):
        assert c[4] is None or abs(got[k] - c[4]) < 0.5, (k, got[k])
    assert got[99] is None and abs(got[4] - geodesic.inverse_m(*(np.array([v]) for v in (10.0, -0.5, 10.0, 0.5)))[0]) < 1e-6
    rng = np.random.default_rng(1)
    p = pd.DataFrame(rng.uniform(-80, 80, (200, 4)), columns=list("abcd"))
    there, back = geodesic.inverse_m(*(p[c].to_numpy() for c in "abcd")), geodesic.inverse_m(*(p[c].to_numpy() for c in "cdab"))
    assert np.allclose(there, back, atol=1e-4)
