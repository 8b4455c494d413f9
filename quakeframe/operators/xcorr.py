"""Waveform refinement: edges of double differences to lags between the traces of both picks.

Each pick's windows are cut once from the trace that holds them, by component; edges then join the cut samples of both sides, and
coefficients are computed in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.weights import band_and_instrument, orientation
from .joins import canonical_xcorr, containing_trace
from .waveform import demeaned, l2_norm, lags_of, radial_transverse, resampled, sliced, xcorr_window

EDGE = ["ref_id", "neigh_id", "station_id", "type"]


@dataclass(frozen=True)
class PhaseOptions:
    """For the picks of one phase group: window in s around a pick, growth with the travel time, longest lag in s, and components in the order they are tried."""

    start: float
    end: float
    scaling: float = 0.0
    max_delay: float = 0.5
    components: tuple[str, ...] = ()


@dataclass(frozen=True)
class XcorrOptions:
    """Windows in s around a pick, by phase group; limits below 0 are off; without ``components`` the pick's own orientation counts. Components are
    orientations, or R, T (motion away from the event, and to the right of that) or L2 (length of the horizontal motion), which are made of N
    and E. ``resample_hz`` above 0 brings all traces to one rate, so that those of different rates can be compared. ``by_phase`` has
    options of their own for phase groups, instead of the ones here."""

    windows: tuple[tuple[str, float, float], ...] = (("P", -0.5, 0.75), ("S", -0.5, 0.75))
    scaling: float = 0.0
    max_delay: float = 0.5
    components: tuple[str, ...] = ()
    min_station_km: float = 0.0
    max_station_km: float = -1.0
    max_event_km: float = -1.0
    resample_hz: float = 0.0
    by_phase: tuple[tuple[str, PhaseOptions], ...] = ()

    def phases(self) -> dict[str, PhaseOptions]:
        """``by_phase``, or the same options for each of ``windows``."""
        return dict(self.by_phase) or {group: PhaseOptions(a, b, self.scaling, self.max_delay, self.components) for group, a, b in self.windows}

    def uses(self, *components: str) -> bool:
        return any(set(p.components) & set(components) for p in self.phases().values())


#: What R, T and L2 are made of.
HORIZONTAL = ("N", "E")


def windowed_picks(picks: DataFrame, traces: DataFrame, o: XcorrOptions) -> DataFrame:
    """event_id, station_id, type, component, rank (of the component), max_delay, sfreq, short and long samples of each pick (event_id, station_id, type,
    group, channel, t_us, travel_time, and for R and T back_azimuth in degrees) with a trace (trace_id, station_id, component, start_us, sfreq,
    samples) around it, or, for R, T and L2, two at one rate. Windows are demeaned before components are turned."""
    bounds = None
    for group, p in o.phases().items():
        spans = [x for delay in (0.0, p.max_delay) for x in xcorr_window(F.col("t_us"), p.start, p.end, F.coalesce("travel_time", F.lit(0.0)), p.scaling, delay)]
        wanted = F.array(*map(F.lit, p.components)) if p.components else F.array(orientation(F.col("channel")))
        own = F.struct(*[x.alias(n) for n, x in zip(("a", "b", "start_us", "end_us"), spans, strict=True)], F.lit(p.max_delay).alias("max_delay"), wanted.alias("wanted"))
        bounds = F.when(F.col("group") == group, own) if bounds is None else bounds.when(F.col("group") == group, own)
    turn = F.col("back_azimuth").cast("double") if "back_azimuth" in picks.columns else F.lit(None).cast("double")
    asked = picks.withColumn("w", bounds).where("w is not null").select("event_id", "station_id", "type", turn.alias("turn"), "w.a", "w.b", "w.start_us", "w.end_us", "w.max_delay", F.posexplode("w.wanted").alias("rank", "wanted"))
    turned = F.col("wanted").isin("R", "T", "L2")
    asked = asked.withColumn("component", F.explode(F.when(turned, F.array(*map(F.lit, HORIZONTAL))).otherwise(F.array("wanted"))))
    keys = ["station_id", "component"]
    spans = traces.withColumns({"trace_start_us": F.col("start_us"), "trace_end_us": F.col("start_us") + F.floor((F.size("samples") - 1) * 1e6 / F.col("sfreq"))})
    hit = containing_trace(asked.select(*keys, "start_us", "end_us").distinct(), spans.select(*keys, "trace_start_us", "trace_end_us", "trace_id"), keys)
    found = asked.join(hit, [*keys, "start_us", "end_us"])
    used = traces.select("trace_id", "sfreq", "samples")
    if o.resample_hz > 0:
        used = resampled(used.join(hit.select("trace_id").distinct(), "trace_id", "left_semi"), o.resample_hz)
    found = found.join(used, "trace_id")
    cut = [demeaned(sliced(F.col("samples"), F.col("trace_start_us"), F.col("sfreq"), F.col(a), F.col(b))).alias(n) for n, a, b in (("short", "a", "b"), ("long", "start_us", "end_us"))]
    names = ["event_id", "station_id", "type", "rank", "max_delay"]
    found = found.select(*names, "wanted", "component", "turn", "sfreq", *cut)
    if not o.uses("R", "T", "L2"):
        return found.select("event_id", "station_id", "type", "component", "rank", "max_delay", "sfreq", "short", "long")
    side = lambda c: F.max(F.when(F.col("component") == c, F.struct("sfreq", "short", "long")))
    pair = found.where(turned).groupBy(*names, "wanted").agg(F.max("turn").alias("turn"), *(side(c).alias(c) for c in HORIZONTAL)).where("N is not null and E is not null and N.sfreq = E.sfreq")
    made = []
    for span in ("short", "long"):
        radial, transverse = radial_transverse(F.col(f"N.{span}"), F.col(f"E.{span}"), F.col("turn"))
        made.append(F.when(F.col("wanted") == "L2", demeaned(l2_norm(F.col(f"N.{span}"), F.col(f"E.{span}")))).when(F.col("wanted") == "R", radial).otherwise(transverse).alias(span))
    pair = pair.where("wanted = 'L2' or turn is not null").select("event_id", "station_id", "type", F.col("wanted").alias("component"), "rank", "max_delay", "N.sfreq", *made)
    return found.where(~turned).select(pair.columns).unionByName(pair)


def gated(edges: DataFrame, picks: DataFrame, events: DataFrame, stations: DataFrame, o: XcorrOptions) -> DataFrame:
    """The edges whose events and station are near enough, and whose picks are on the same band and instrument; with both
    picks' ``trusted1`` and ``trusted2``."""
    ev = events.select("id", "latitude", "longitude", "depth")
    st = stations.select(F.col("id").alias("station_id"), F.col("latitude").alias("st_lat"), F.col("longitude").alias("st_lon"), geo.station_depth(F.col("elevation")).alias("st_dep"))
    trusted = F.coalesce(F.col("trusted"), F.lit(True)) if "trusted" in picks.columns else F.lit(True)
    rows = edges.select(*EDGE).distinct().join(st, "station_id")
    for k, name in ((1, "ref_id"), (2, "neigh_id")):
        own = picks.select(F.col("event_id").alias(name), "station_id", "type", band_and_instrument(F.col("channel")).alias(f"code{k}"), trusted.alias(f"trusted{k}"))
        rows = rows.join(own, [name, "station_id", "type"]).join(ev.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}{k}") for c in ("latitude", "longitude", "depth")]), name)
    point = {k: [F.col(f"{c}{k}") for c in ("latitude", "longitude", "depth")] for k in (1, 2)}
    station = geo.distance3d(*point[1], F.col("st_lat"), F.col("st_lon"), F.col("st_dep"))
    ok = (F.col("code1") == F.col("code2")) & (station >= o.min_station_km)
    if o.max_station_km >= 0:
        ok &= station <= o.max_station_km
    if o.max_event_km >= 0:
        ok &= geo.distance3d(*point[1], *point[2]) <= o.max_event_km
    return rows.where(ok).select(*EDGE, "trusted1", "trusted2")


def correlated(edges: DataFrame, windows: DataFrame) -> DataFrame:
    """EDGE, valid, coefficient, lag and component of ``gated`` edges. The side of a trusted pick keeps its short window; with both
    or neither trusted, both ways are tried and the greater coefficient stays. The first component that works counts."""
    side = ["station_id", "type", "component"]
    rows = edges
    for k, name in ((1, "ref_id"), (2, "neigh_id")):
        own = windows.select(F.col("event_id").alias(name), *side, *(["rank", "max_delay"] if k == 1 else []), F.col("sfreq").alias(f"sfreq{k}"), F.col("short").alias(f"short{k}"), F.col("long").alias(f"long{k}"))
        rows = rows.join(own, [name, "station_id", "type"] if k == 1 else [name, *side])
    rows = rows.where("sfreq1 = sfreq2 and long1 is not null and long2 is not null")
    names = [*EDGE, "component", "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema.fields) + ", coefficient double, lag double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            trusted, f = b[["trusted1", "trusted2"]].to_numpy(bool), b.sfreq1.to_numpy(float)
            both = trusted[:, 0] == trusted[:, 1]
            ways = [(both | trusted[:, 1], "long1", "short2"), (both | trusted[:, 0], "short1", "long2")]
            best, lags, cut = np.full((2, len(b)), np.nan), np.full((2, len(b)), np.nan), np.ones(len(b), bool)
            for k, (asked, one, two) in enumerate(ways):
                at = np.flatnonzero(asked)
                best[k, at], lags[k, at] = lags_of(b[one].iloc[at].to_list(), b[two].iloc[at].to_list(), f[at], b.max_delay.to_numpy(float)[at])
                cut &= ~(asked & (b[one].isna() | b[two].isna()).to_numpy())  # a way whose short window can't be cut makes the component fail
            k = (np.nan_to_num(np.abs(best[1]), nan=-1.0) > np.nan_to_num(np.abs(best[0]), nan=-1.0)).astype(int)
            row = np.arange(len(b))
            known = cut & ~np.isnan(best[k, row])
            out = b[names].copy()
            out["coefficient"], out["lag"] = (pd.array(np.where(known, v[k, row], None), "Float64") for v in (best, lags))
            yield out

    done = rows.mapInPandas(run, schema).where("coefficient is not null").groupBy(*EDGE).agg(F.min(F.struct("rank", "component", "coefficient", "lag")).alias("best"))
    out = edges.select(*EDGE).join(done, EDGE, "left")
    return out.select(*EDGE, F.col("best").isNotNull().alias("valid"), F.col("best.coefficient").alias("coefficient"), F.col("best.lag").alias("lag"), F.col("best.component").alias("component"))


def correlate_edges(edges: DataFrame, picks: DataFrame, events: DataFrame, stations: DataFrame, traces: DataFrame, o: XcorrOptions, known: DataFrame | None = None) -> DataFrame:
    """A cache of lags for the edges: ev1 < ev2, station_id, type, valid, coefficient, lag. Pairs that ``known``, such a cache, has are taken from it,
    failures too; others are computed."""
    pair = {"ev1": F.least("ref_id", "neigh_id"), "ev2": F.greatest("ref_id", "neigh_id")}
    asked = edges.select(*EDGE).withColumns(pair).dropDuplicates(["ev1", "ev2", "station_id", "type"])
    if known is not None:
        asked = asked.join(known.select("ev1", "ev2", "station_id", "type"), ["ev1", "ev2", "station_id", "type"], "left_anti")
    if o.uses("R", "T"):
        ev = events.select(F.col("id").alias("event_id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
        st = stations.select(F.col("id").alias("station_id"), F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"))
        there = picks.join(ev, "event_id").join(st, "station_id")
        turned = there.withColumn("back_azimuth", F.degrees(geo.azimuth(*[F.col(c) for c in ("_slat", "_slon", "_lat", "_lon")]))).drop("_lat", "_lon", "_slat", "_slon")
    else:
        turned = picks
    found = correlated(gated(asked, picks, events, stations, o), windowed_picks(turned, traces, o))
    found = found.select(F.col("ref_id").alias("ev1"), F.col("neigh_id").alias("ev2"), "station_id", "type", "valid", "coefficient", "lag", F.lit(1).alias("_order"))
    if known is not None:
        found = found.unionByName(known.select("ev1", "ev2", "station_id", "type", "valid", "coefficient", "lag", F.lit(0).alias("_order")))
    return canonical_xcorr(found, "_order").drop("_order")
