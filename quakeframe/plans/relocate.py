"""Relocation of catalogs and of single events by double differences.

Neighbours, clusters, weights and the table of observations are DataFrames; then each cluster, which is independent of the others, is
one group of ``applyInPandas`` in which the weighted system is built and solved again and again with numpy. Clusters with more
observations than ``Options.most_rows`` aren't: their vectors and matrices stay tables, and each iteration is a number of joins and sums.

Travel times come from a spec, ``Options.times``: straight rays, a table, or any function of numpy arrays of the same form. Where it has none
(NaN), a phase isn't used; an event that a move leaves without any, of the phases it has as a reference, goes back to where it was.

``moved`` tells events that a solution has moved, and that didn't go back, from those that are where they were: without observations of any weight,
held fixed, or in a cluster whose first solve was rejected."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.weights import MAD_SCALE, schedule
from ..tables import drop, settled
from ..operators.grids import Beyond, GridTables, array_times
from ..operators.joins import lookup_xcorr
from ..operators.neighbours import Selection, by_shells, clusters, eligible_edges, nearest_first, select_neighbours
from ..operators.stats import quantiles
from ..operators.xcorr import XcorrOptions, correlate_edges
from ..schema import Catalog
from .solver import CONDITION, solve, solve_distributed

EARTH_KM = 6371.00877141506
RESULT = "event_id bigint, cluster_id bigint, latitude double, longitude double, depth double, t_us bigint, start_rms double, final_rms double, n_obs bigint, moved boolean, stopped string"
#: Of each event and phase: residuals before and after, mean weight and number of the observations that use it.
PHASES = "event_id bigint, cluster_id bigint, station_id string, type string, start_residual double, final_residual double, weight double, n_obs bigint, used boolean"
#: Of each observation, as the last iteration has it.
DIFFERENCES = "ref_id bigint, neigh_id bigint, cluster_id bigint, station_id string, type string, weight double, xcorr_used boolean, coefficient double, residual double, distance double"
#: (latitude, longitude, depth of events; latitude, longitude, elevation of stations; phase group) to travel times (s), and their change
#: per km that an event goes east, north and up.
Times = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Options:
    """``alpha``, ``damping`` and ``omega`` run from their first to their second value over the iterations; alpha 0 leaves residual weights out,
    omega 0 the constraints by absolute travel times. ``margin_km``: how far around a cluster's events cells of grids are sent with them at first; a
    cluster of which an event goes farther is solved again with twice as many."""

    iterations: int = 20
    alpha: tuple[float, float] = (0.0, 0.0)
    damping: tuple[float, float] = (0.01, 0.01)
    omega: tuple[float, float] = (0.0, 0.0)
    p_km_s: float = 5.8
    s_km_s: float = 3.36
    solver: str = "LSMR"
    pick_weights: bool = True
    min_coefficient: float = 0.5
    xcorr_scaler: float = 2.0
    selection: Selection = field(default_factory=Selection)
    times: Times | GridTables | None = None
    margin_km: float = 5.0
    most_rows: int = 2_000_000

    @property
    def travel_times(self) -> Times:
        return self.times or straight_rays(self.p_km_s, self.s_km_s)


def observations(cat: Catalog, edges: DataFrame, picks: DataFrame, xcorr: DataFrame | None = None) -> DataFrame:
    """One wide row for each edge, with both events, both picks and the station: all that a cluster's solution needs."""
    ev = cat.events.select("id", "latitude", "longitude", "depth", "t_us")
    pk = picks.where("group in ('P', 'S')").select("event_id", "station_id", "type", "group", F.col("t_us").alias("pick_us"), "class_weight")
    pk = pk.groupBy("event_id", "station_id", "type").agg(F.min(F.struct("pick_us", "group", "class_weight")).alias("_p")).select("event_id", "station_id", "type", "_p.*")  # the first of several
    rows = edges.select("cluster_id", "ref_id", "neigh_id", "type", "station_id")
    for k, name in ((1, "ref_id"), (2, "neigh_id")):
        side = pk.join(ev.withColumnRenamed("id", "event_id"), "event_id")
        side = side.select(F.col("event_id").alias(name), "station_id", "type", *[F.col(c).alias(f"{c}{k}") for c in ("latitude", "longitude", "depth", "t_us", "pick_us", "class_weight")], *(["group"] if k == 1 else []))
        rows = rows.join(side, [name, "station_id", "type"])
    st = cat.stations.select(F.col("id").alias("station_id"), F.col("latitude").alias("st_lat"), F.col("longitude").alias("st_lon"), "elevation")
    rows = rows.join(st, "station_id").where("pick_us1 >= t_us1 and pick_us2 >= t_us2")
    if xcorr is None:
        return rows.withColumns({"coefficient": F.lit(None).cast("double"), "lag": F.lit(None).cast("double")})
    found = lookup_xcorr(rows, xcorr) if "ev1" in xcorr.columns else rows.join(xcorr.select("ref_id", "neigh_id", "type", "station_id", "valid", "coefficient", "lag"), ["ref_id", "neigh_id", "type", "station_id"], "left")
    return found.withColumns({c: F.when(F.col("valid"), F.col(c)) for c in ("coefficient", "lag")}).drop("valid")


def _ray(lat: np.ndarray, lon: np.ndarray, depth: np.ndarray, st: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Travel times, and their change per km east, north and up, of straight rays."""
    f1, f2, dl = np.radians(lat), np.radians(st[:, 0]), np.radians(st[:, 1] - lon)
    a = np.sin((f2 - f1) / 2) ** 2 + np.cos(f1) * np.cos(f2) * np.sin(dl / 2) ** 2
    along = 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a)) * (EARTH_KM - (depth - st[:, 2] / 1000) / 2)
    az = np.arctan2(np.sin(dl) * np.cos(f2), np.cos(f1) * np.sin(f2) - np.sin(f1) * np.cos(f2) * np.cos(dl))
    up = depth + st[:, 2] / 1000
    dip = np.arctan2(up, along)
    return np.hypot(along, up) / v, np.stack([-np.sin(az) * np.cos(dip) / v, -np.cos(az) * np.cos(dip) / v, -np.sin(dip) / v], 1)


def straight_rays(p_km_s: float, s_km_s: float) -> Times:
    def times(lat, lon, depth, station, group):
        return _ray(lat, lon, depth, station, np.where(group == "P", p_km_s, s_km_s))

    return times


def table_times(table: pd.DataFrame) -> Times:
    """Times from a table (group, distance_km, depth_km, travel_time) that is a regular grid for each group; the distance is that on the surface.
    Outside the grid there are none. The table is a parameter of the job, as velocities are, and goes to each task."""
    grids = {}
    for group, own in table.groupby("group"):
        grid = own.pivot(index="distance_km", columns="depth_km", values="travel_time").sort_index().sort_index(axis=1)
        grids[group] = (grid.index.to_numpy(float), grid.columns.to_numpy(float), grid.to_numpy(float))

    def times(lat, lon, depth, station, group):
        f1, f2, dl = np.radians(lat), np.radians(station[:, 0]), np.radians(station[:, 1] - lon)
        a = np.sin((f2 - f1) / 2) ** 2 + np.cos(f1) * np.cos(f2) * np.sin(dl / 2) ** 2
        far = 2 * np.arcsin(np.sqrt(np.clip(a, 0, 1))) * EARTH_KM
        az = np.arctan2(np.sin(dl) * np.cos(f2), np.cos(f1) * np.sin(f2) - np.sin(f1) * np.cos(f2) * np.cos(dl))
        tt, across, down = np.full((3, len(lat)), np.nan)
        for name, (xs, zs, grid) in grids.items():
            at = np.flatnonzero((group == name) & (far >= xs[0]) & (far <= xs[-1]) & (depth >= zs[0]) & (depth <= zs[-1]))
            i, k = (np.clip(np.searchsorted(line, v[at], "right") - 1, 0, len(line) - 2) for line, v in ((xs, far), (zs, depth)))
            dx, dz = xs[i + 1] - xs[i], zs[k + 1] - zs[k]
            x, z = (far[at] - xs[i]) / dx, (depth[at] - zs[k]) / dz
            c00, c01, c10, c11 = grid[i, k], grid[i, k + 1], grid[i + 1, k], grid[i + 1, k + 1]
            tt[at] = (c00 * (1 - z) + c01 * z) * (1 - x) + (c10 * (1 - z) + c11 * z) * x
            across[at] = ((c10 - c00) * (1 - z) + (c11 - c01) * z) / dx
            down[at] = ((c01 - c00) * (1 - x) + (c11 - c10) * x) / dz
        return tt, np.stack([-np.sin(az) * across, -np.cos(az) * across, -down], 1)

    return times


def _moved(lat: np.ndarray, lon: np.ndarray, depth: np.ndarray, east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, az, f = np.hypot(east, north) / (EARTH_KM - depth), np.arctan2(east, north), np.radians(lat)
    to = np.arcsin(np.sin(f) * np.cos(d) + np.cos(f) * np.sin(d) * np.cos(az))
    turn = np.arctan2(np.sin(az) * np.sin(d) * np.cos(f), np.cos(d) - np.sin(f) * np.sin(to))
    return np.degrees(to), (lon + np.degrees(turn) + 180) % 360 - 180


class Cluster:
    """One cluster's observations as arrays: events, their distinct picks, and pairs of picks."""

    def __init__(self, obs: pd.DataFrame, o: Options, free: bool):
        obs = obs.sort_values(["ref_id", "neigh_id", "station_id", "type"], ignore_index=True)
        self.obs, self.id = obs, obs.cluster_id.iloc[0]
        self.events = np.unique(np.concatenate([obs.ref_id, obs.neigh_id]))
        self.ref, self.neigh = np.searchsorted(self.events, obs.ref_id), np.searchsorted(self.events, obs.neigh_id)
        #: latitude, longitude, depth, and time after the first origin time, in s
        self.where, self.origin = np.zeros((len(self.events), 4)), np.zeros(len(self.events), np.int64)
        for k, at in ((1, self.ref), (2, self.neigh)):
            self.where[at, :3] = obs[[f"latitude{k}", f"longitude{k}", f"depth{k}"]].to_numpy()
            self.origin[at] = obs[f"t_us{k}"].to_numpy()
        self.moving = np.ones(len(self.events), bool) if free else np.isin(np.arange(len(self.events)), self.ref)
        names = pd.factorize(pd.concat([obs.station_id + "/" + obs.type] * 2, ignore_index=True))[0]
        owner = np.concatenate([self.ref, self.neigh])
        _, first, pick = np.unique(owner * (names.max() + 1) + names, return_index=True, return_inverse=True)
        both = pd.concat([obs, obs], ignore_index=True)
        quality = np.concatenate([obs.class_weight1, obs.class_weight2]).astype(float)
        self.owner, self.one, self.two = owner[first], pick[: len(obs)], pick[len(obs) :]
        self.observed = np.concatenate([obs.pick_us1 - obs.t_us1, obs.pick_us2 - obs.t_us2])[first] / 1e6
        self.station, self.group = both[["st_lat", "st_lon", "elevation"]].to_numpy()[first], both.group.to_numpy()[first]
        self.names = both[["station_id", "type"]].iloc[first]
        self.quality = quality[first] if o.pick_weights else np.ones(len(first))
        weight = (quality[: len(obs)] + quality[len(obs) :]) / 2 if o.pick_weights else np.ones(len(obs))
        coefficient, lag = np.nan_to_num(np.abs(obs.coefficient.to_numpy(float))), np.nan_to_num(obs.lag.to_numpy(float))
        self.with_lag = coefficient >= o.min_coefficient
        self.weight = np.where(self.with_lag, weight * (1 + (o.xcorr_scaler - 1) * coefficient), weight)
        self.lag = np.where(self.with_lag, lag, 0.0)

    def by_event(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, values, len(self.events))

    def by_pick(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([self.one, self.two]), np.tile(values, 2), len(self.owner))

    def timed(self, where: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
        """Residuals of picks, NaN without a travel time, and the travel times' slopes."""
        at = where[self.owner]
        tt, slope = o.travel_times(at[:, 0], at[:, 1], at[:, 2], self.station, self.group)
        return self.observed - at[:, 3] - tt, slope

    def rms(self, residual: np.ndarray) -> np.ndarray:
        known = np.isfinite(residual)
        above, below = self.by_event(np.where(known, (np.nan_to_num(residual) * self.quality) ** 2, 0)), self.by_event(np.where(known, self.quality**2, 0))
        return np.sqrt(np.divide(above, below, out=np.full(len(self.events), np.nan), where=below > 0))


def _solved(c: Cluster, o: Options, i: int, residual: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Step of each event (km east, north, up, and s), which events it is good for, the observations' weights, and why the solver stopped."""
    d = residual[c.one] - residual[c.two] - c.lag
    known = np.isfinite(d)
    w, d = np.where(known, c.weight, 0.0), np.nan_to_num(d)
    if (alpha := schedule(*o.alpha, i, o.iterations)) > 0 and known.any():
        mad = np.median(np.abs(d[known] - np.median(d[known])))
        w = w * (np.maximum(0, 1 - (d * MAD_SCALE / (alpha * mad)) ** 2) ** 2 if mad > 0 else (d == 0))
    n_used, total = c.by_pick((w > 0).astype(float)), c.by_pick(w)
    hold = schedule(*o.omega, i, o.iterations) * np.divide(total, n_used, out=np.zeros(len(c.owner)), where=n_used > 0) * c.moving[c.owner]
    full = np.nan_to_num(np.concatenate([slope, np.ones((len(c.owner), 1))], 1)) * c.moving[c.owner][:, None]
    col, n = c.owner[:, None] * 4 + np.arange(4), 4 * len(c.events)
    norm = np.sqrt(sum(np.bincount(col[p].ravel(), (full[p] * x[:, None]).ravel() ** 2, n) for p, x in ((c.one, w), (c.two, w), (np.arange(len(c.owner)), hold))))
    scale = np.divide(1.0, norm, out=np.ones(n), where=norm > 0)

    def forward(x: np.ndarray) -> np.ndarray:
        t = (full * (x * scale)[col]).sum(axis=1)
        return np.concatenate([w * (t[c.one] - t[c.two]), hold * t])

    def transposed(y: np.ndarray) -> np.ndarray:
        a, b = w * y[: len(w)], hold * y[len(w) :]
        t = np.bincount(c.one, a, len(c.owner)) - np.bincount(c.two, a, len(c.owner)) + b
        return np.bincount(col.ravel(), (full * t[:, None]).ravel(), n) * scale

    x, stopped = solve(o.solver, forward, transposed, np.concatenate([w * d, hold * np.nan_to_num(residual)]), n, schedule(*o.damping, i, o.iterations))
    step = (x * scale).reshape(-1, 4)
    used = np.bincount(np.concatenate([c.ref, c.neigh]), np.tile(w > 0, 2), len(c.events)) > 0
    return step, c.moving & used & np.isfinite(step).all(axis=1), w, stopped


def _shifted(where: np.ndarray, step: np.ndarray, ok: np.ndarray) -> np.ndarray:
    step = np.where(ok[:, None], step, 0.0)
    lat, lon = _moved(where[:, 0], where[:, 1], where[:, 2], step[:, 0], step[:, 1])
    new = np.stack([lat, lon, where[:, 2] - step[:, 2], where[:, 3] + step[:, 3]], 1)
    return np.where((ok & np.isfinite(new).all(axis=1))[:, None], new, where)


def solve_cluster(obs: pd.DataFrame, o: Options, free: bool = True, result: str = RESULT) -> pd.DataFrame:
    """The events of one cluster's observations, relocated; with ``free`` off, only those that are a reference move. ``result``: RESULT, PHASES or
    DIFFERENCES. A solve whose system is conditioned too badly is rejected, and ends the iterations."""
    c = Cluster(obs, o, free)
    where, stopped, w = c.where, "", c.weight
    moved, as_ref = np.zeros(len(c.events), bool), np.isin(np.arange(len(c.owner)), c.one)
    residual, slope = c.timed(where, o)
    first, start = residual, c.rms(residual)
    for i in range(o.iterations):
        step, ok, w, stopped = _solved(c, o, i, residual, slope)
        if stopped == CONDITION:
            break
        new = _shifted(where, step, ok)
        after, slopes = c.timed(new, o)
        timed = c.by_event((as_ref & np.isfinite(after)).astype(float))
        back = (moved | ok) & (c.by_event(as_ref.astype(float)) > 0) & (timed == 0)  # outside what there are travel times for
        if back.any():
            new = np.where(back[:, None], where, new)
            after, slopes = c.timed(new, o)
        moved = np.where(back, moved, moved | ok)
        where, residual, slope = new, after, slopes
    if result == DIFFERENCES:
        d = residual[c.one] - residual[c.two] - c.lag
        far = geo_distance(where[c.ref], where[c.neigh])
        return pd.DataFrame({
            "ref_id": c.obs.ref_id, "neigh_id": c.obs.neigh_id, "cluster_id": c.id, "station_id": c.obs.station_id, "type": c.obs.type, "weight": w, "xcorr_used": c.with_lag,
            "coefficient": c.obs.coefficient, "residual": d, "distance": far,
        })
    if result == PHASES:
        n, total = c.by_pick((w > 0).astype(float)), c.by_pick(w)
        return pd.DataFrame({
            "event_id": c.events[c.owner], "cluster_id": c.id, "station_id": c.names.station_id.to_numpy(), "type": c.names.type.to_numpy(), "start_residual": first, "final_residual": residual,
            "weight": np.divide(total, n, out=np.zeros(len(n)), where=n > 0), "n_obs": n.astype(np.int64), "used": n > 0,
        })
    n_obs = np.bincount(np.concatenate([c.ref, c.neigh]), minlength=len(c.events))
    return pd.DataFrame({
        "event_id": c.events, "cluster_id": c.id, "latitude": where[:, 0], "longitude": where[:, 1], "depth": where[:, 2],
        "t_us": c.origin + np.rint(where[:, 3] * 1e6).astype(np.int64), "start_rms": start, "final_rms": c.rms(residual), "n_obs": n_obs, "moved": moved, "stopped": stopped,
    })


def geo_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """km between rows of latitude, longitude, depth: along the surface at the mean depth, and across."""
    f1, f2, dl = np.radians(a[:, 0]), np.radians(b[:, 0]), np.radians(b[:, 1] - a[:, 1])
    h = np.sin((f2 - f1) / 2) ** 2 + np.cos(f1) * np.cos(f2) * np.sin(dl / 2) ** 2
    return np.hypot(2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))) * (EARTH_KM - (a[:, 2] + b[:, 2]) / 2), a[:, 2] - b[:, 2])


def _timed_rows(picks: DataFrame, state: DataFrame, o: Options) -> DataFrame:
    """Picks of a large cluster with their residuals and slopes; both are NULL where there is no travel time."""
    rows = picks.join(state, "event_id").select("pick", "event_id", "as_ref", "quality", "moving", "latitude", "longitude", "depth", "station_id", "st_lat", "st_lon", "elevation", "group", (F.col("observed") - F.col("shift")).alias("left"))
    if isinstance(o.times, GridTables):
        return o.times.timed(rows).select("pick", "event_id", "as_ref", "quality", "moving", "residual", "dx", "dy", "dz")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tt, slope = o.travel_times(*(b[c].to_numpy(float) for c in ("latitude", "longitude", "depth")), b[["st_lat", "st_lon", "elevation"]].to_numpy(float), b.group.to_numpy())
            yield pd.DataFrame({"pick": b["pick"], "event_id": b.event_id, "as_ref": b.as_ref, "quality": b.quality, "moving": b.moving, "residual": b.left - tt, "dx": slope[:, 0], "dy": slope[:, 1], "dz": slope[:, 2]})

    found = rows.mapInPandas(run, "pick bigint, event_id bigint, as_ref boolean, quality double, moving boolean, residual double, dx double, dy double, dz double")
    return found.withColumn("residual", F.when(~F.isnan("residual"), F.col("residual")))


def _median(df: DataFrame, value: str) -> float | None:
    """By ranks, so no task holds all values."""
    found = quantiles(df, value, [0.5])
    row = found.first()
    drop(found)
    return row and row[1]


def _large_system(pairs: DataFrame, timed: DataFrame, o: Options, i: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of iteration i the rows (row, one, two, d, weight) with weight, the matrix (row, col, value) and its right side (row, value); the first two
    are settled."""
    a, b = (timed.select(F.col("pick").alias(n), F.col("residual").alias(f"r_{n}")) for n in ("one", "two"))
    rows = pairs.join(a, "one").join(b, "two").withColumn("d", F.col("r_one") - F.col("r_two") - F.col("lag")).where("d is not null")
    whole = None
    if (alpha := schedule(*o.alpha, i, o.iterations)) > 0:
        rows = whole = settled(rows)
        middle = _median(rows, "d")
        mad = _median(rows.select(F.abs(F.col("d") - middle).alias("d")), "d") if middle is not None else 0.0
        x = F.col("d") * MAD_SCALE / (alpha * mad) if mad > 0 else None
        rows = rows.withColumn("weight", F.col("weight") * (F.greatest(F.lit(0.0), 1 - x * x) ** 2 if x is not None else F.when(F.col("d") == 0, 1.0).otherwise(0.0)))
    rows = settled(rows.where("weight > 0").select("row", "one", "two", "d", "weight"))
    drop(whole)
    used = rows.select(F.explode(F.array("one", "two")).alias("pick"), "weight").groupBy("pick").agg((schedule(*o.omega, i, o.iterations) * F.avg("weight")).alias("weight"))
    # rows of observations count up from 0, those that hold a pick down from -1
    hold = timed.where("moving").join(used, "pick").where("weight > 0").select((-1 - F.col("pick")).alias("row"), "pick", F.col("residual").alias("d"), "weight", F.lit(1.0).alias("sign"))
    sides = [rows.select("row", F.col(n).alias("pick"), "d", "weight", F.lit(s).alias("sign")) for n, s in (("one", 1.0), ("two", -1.0))]
    terms = sides[0].unionByName(sides[1]).unionByName(hold).join(timed.where("moving").select("pick", "event_id", "dx", "dy", "dz"), "pick")
    axis = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in enumerate((F.col("dx"), F.col("dy"), F.col("dz"), F.lit(1.0))))))
    matrix = settled(terms.withColumn("a", axis).select("row", (F.col("event_id") * 4 + F.col("a.k")).alias("col"), (F.col("sign") * F.col("weight") * F.col("a.v")).alias("value")))
    right = rows.select("row", (F.col("d") * F.col("weight")).alias("value")).unionByName(hold.select("row", (F.col("d") * F.col("weight")).alias("value")))
    return rows, matrix, right


def _large_step(state: DataFrame, timed: DataFrame, rows: DataFrame, matrix: DataFrame, right: DataFrame, o: Options, i: int) -> tuple[DataFrame | None, str]:
    """Where events go, with ``ok`` for those that the solution is good for; None if it's rejected. Settled."""
    scale = settled(matrix.groupBy("col").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).where("norm > 0"))
    scaled = matrix.join(scale, "col").select("row", "col", (F.col("value") / F.col("norm")).alias("value"))
    x, stopped = solve_distributed(scaled, right, schedule(*o.damping, i, o.iterations), method=o.solver)
    moved = None
    if stopped != CONDITION:
        steps = x.join(scale, "col").select(F.floor(F.col("col") / 4).alias("event_id"), F.pmod("col", F.lit(4)).alias("k"), (F.col("x") / F.col("norm")).alias("x"))
        steps = steps.groupBy("event_id").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("x"))), F.lit(0.0)).alias(n) for k, n in enumerate(("east", "north", "up", "later"))])
        used = rows.select(F.explode(F.array("one", "two")).alias("pick")).distinct().join(timed.select("pick", "event_id"), "pick").select("event_id", F.lit(True).alias("used")).distinct()
        moved = state.join(steps, "event_id", "left").join(used, "event_id", "left").fillna(0.0, ["east", "north", "up", "later"])
        lat, lon = geo.move(F.col("latitude"), F.col("longitude"), F.hypot("east", "north"), F.atan2("east", "north"), F.col("depth"))
        ok = F.col("moving") & F.coalesce("used", F.lit(False))
        places = {"latitude": lat, "longitude": lon, "depth": F.col("depth") - F.col("up"), "shift": F.col("shift") + F.col("later")}
        moved = settled(moved.select("event_id", "moving", (F.col("moved") | ok).alias("moved"), *(F.when(ok, v).otherwise(F.col(k)).alias(k) for k, v in places.items())))
    drop(x, scale)
    return moved, stopped


def relocate_large(obs: DataFrame, o: Options, free: bool = True, result: str = RESULT) -> DataFrame:
    """One cluster as ``solve_cluster`` gives it, with all vectors and matrices as tables. Of an iteration's values only the median deviation, the
    solver's scalars and whether an event has to go back reach the driver. An iteration writes its rows, matrix, scale, state and residuals, and twice
    four tables of ranks if residuals weigh; the solver two tables a step. All of them are deleted when the next ones have been written."""
    ends = None
    for k, name in ((1, "ref_id"), (2, "neigh_id")):
        side = obs.select(F.col(name).alias("event_id"), "cluster_id", "station_id", "type", "group", "st_lat", "st_lon", "elevation", *[F.col(f"{c}{k}").alias(c) for c in ("latitude", "longitude", "depth", "t_us", "pick_us", "class_weight")], F.lit(k == 1 or free).alias("moving"), F.lit(k == 1).alias("as_ref"))
        ends = side if ends is None else ends.unionByName(side)
    origin = settled(ends.groupBy("event_id").agg(*[F.first(c).alias(c) for c in ("cluster_id", "latitude", "longitude", "depth", "t_us")], F.max("moving").alias("moving"), F.count("*").alias("n_obs")))
    weight = F.col("class_weight").cast("double") if o.pick_weights else F.lit(1.0)
    found = ends.groupBy("event_id", "station_id", "type").agg(*[F.first(c).alias(c) for c in ("cluster_id", "group", "st_lat", "st_lon", "elevation")], F.first((F.col("pick_us") - F.col("t_us")) / 1e6).alias("observed"), F.first(weight).alias("quality"), F.max("as_ref").alias("as_ref"))
    picks = settled(found.withColumn("pick", F.monotonically_increasing_id()))
    coefficient = F.coalesce(F.abs("coefficient"), F.lit(0.0))
    with_lag = coefficient >= o.min_coefficient
    mean = (F.col("class_weight1") + F.col("class_weight2")) / 2.0 if o.pick_weights else F.lit(1.0)
    of = lambda event, pick: picks.select(F.col("event_id").alias(event), "station_id", "type", F.col("pick").alias(pick))
    both = obs.join(of("ref_id", "one"), ["ref_id", "station_id", "type"]).join(of("neigh_id", "two"), ["neigh_id", "station_id", "type"])
    both = both.select("ref_id", "neigh_id", "cluster_id", "station_id", "type", "coefficient", "one", "two", with_lag.alias("xcorr_used"), F.when(with_lag, mean * (1 + (o.xcorr_scaler - 1) * coefficient)).otherwise(mean).alias("weight"), F.when(with_lag, F.coalesce("lag", F.lit(0.0))).otherwise(0.0).alias("lag"))
    both = settled(both.withColumn("row", F.monotonically_increasing_id()))
    pairs = both.select("row", "one", "two", "weight", "lag")
    state = settled(origin.select("event_id", "moving", F.lit(False).alias("moved"), "latitude", "longitude", "depth", F.lit(0.0).alias("shift")))
    timed = first = settled(_timed_rows(picks, state, o))

    stopped, rows = "", None
    for i in range(o.iterations):
        drop(rows)
        rows, matrix, right = _large_system(pairs, timed, o, i)
        new, stopped = _large_step(state, timed, rows, matrix, right, o, i)
        drop(matrix)
        if new is None:
            break
        after = settled(_timed_rows(picks, new, o))
        back = settled(after.where("as_ref").groupBy("event_id").agg(F.count("residual").alias("n")).where("n = 0").join(new.where("moved"), "event_id", "left_semi").select("event_id"))
        if not back.isEmpty():  # outside what there are travel times for
            kept = settled(new.join(back, "event_id", "left_anti").unionByName(state.join(back, "event_id", "left_semi").select(new.columns)))
            drop(new, after)
            new, after = kept, settled(_timed_rows(picks, kept, o))
        drop(back, state, timed if timed is not first else None)
        state, timed = new, after

    weights = pairs.select("row", "weight") if rows is None else rows.select("row", "weight")
    if result == DIFFERENCES:
        a, b = (timed.select(F.col("pick").alias(n), F.col("residual").alias(f"r_{n}")) for n in ("one", "two"))
        at = lambda event, k: state.select(F.col("event_id").alias(event), *[F.col(c).alias(f"{c}{k}") for c in ("latitude", "longitude", "depth")])
        found = both.drop("weight").join(weights, "row", "left").join(a, "one").join(b, "two").join(at("ref_id", 1), "ref_id").join(at("neigh_id", 2), "neigh_id")
        far = geo.distance3d(*[F.col(f"{c}{k}") for k in (1, 2) for c in ("latitude", "longitude", "depth")])
        return found.select("ref_id", "neigh_id", "cluster_id", "station_id", "type", F.coalesce("weight", F.lit(0.0)).alias("weight"), "xcorr_used", "coefficient", (F.col("r_one") - F.col("r_two") - F.col("lag")).alias("residual"), far.alias("distance"))
    if result == PHASES:
        mean = pairs.drop("weight").join(weights, "row").where("weight > 0").select(F.explode(F.array("one", "two")).alias("pick"), "weight").groupBy("pick").agg(F.avg("weight").alias("weight"), F.count("*").alias("n_obs"))
        found = picks.join(first.select("pick", F.col("residual").alias("start_residual")), "pick").join(timed.select("pick", F.col("residual").alias("final_residual")), "pick").join(mean, "pick", "left")
        return found.select("event_id", "cluster_id", "station_id", "type", "start_residual", "final_residual", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("n_obs", F.lit(0)).cast("bigint").alias("n_obs"), F.col("n_obs").isNotNull().alias("used"))

    def rms(timed: DataFrame, name: str) -> DataFrame:
        known = F.when(F.col("residual").isNotNull(), F.col("quality"))
        return timed.groupBy("event_id").agg(F.sqrt(F.try_divide(F.sum((F.col("residual") * known) ** 2), F.sum(known * known))).alias(name))

    found = state.drop("moving").join(origin.select("event_id", "cluster_id", "t_us", "n_obs"), "event_id").join(rms(first, "start_rms"), "event_id").join(rms(timed, "final_rms"), "event_id")
    return found.select("event_id", "cluster_id", "latitude", "longitude", "depth", (F.col("t_us") + F.round(F.col("shift") * 1e6).cast("bigint")).alias("t_us"), "start_rms", "final_rms", "n_obs", "moved", F.lit(stopped).alias("stopped"))


def relocate(obs: DataFrame, o: Options, free: bool = True, result: str = RESULT) -> DataFrame:
    """The events of ``observations``, cluster by cluster, or what became of their PHASES or DIFFERENCES. Clusters with more than ``most_rows``
    observations are solved on tables, with the same results."""
    obs = settled(obs)
    size = obs.groupBy("cluster_id").agg(F.count("*").alias("n"))
    large = size.where(F.col("n") > o.most_rows).select("cluster_id")
    ids = [r[0] for r in large.collect()]  # few, as each has more than ``most_rows`` rows

    few = obs.join(F.broadcast(large), "cluster_id", "left_anti")
    found = _by_grids(few, o, free, result) if isinstance(o.times, GridTables) else few.groupBy("cluster_id").applyInPandas(lambda group: solve_cluster(group, o, free, result), result)
    for k in ids:
        found = found.unionByName(relocate_large(obs.where(F.col("cluster_id") == k), o, free, result))
    return found


def _by_grids(obs: DataFrame, o: Options, free: bool, result: str) -> DataFrame:
    """Clusters that fit a task, each with the cells of its stations' grids around it. Those that need more are solved again with a margin twice as
    wide, until none does: at last a margin takes whole grids."""
    tables, plain = o.times, replace(o, times=None)
    least, found, margin = tables.least_quality, None, o.margin_km

    def run(group: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        try:
            found = solve_cluster(group, replace(plain, times=array_times(sent, least)), free, result)
        except Beyond:
            found = pd.DataFrame([dict.fromkeys(names) | {"cluster_id": group.cluster_id.iloc[0]}])
        return found.astype({c: object for c in texts})  # plain strings, which cogrouped results have to be

    names, texts = [x.split()[0] for x in result.split(", ")], [x.split()[0] for x in result.split(", ") if x.endswith(" string")]
    key = names[0]
    while True:
        sent = settled(tables.around(obs, margin))
        solved = settled(obs.groupBy("cluster_id").cogroup(sent.groupBy("cluster_id")).applyInPandas(run, result))
        drop(sent)
        done = solved.where(F.col(key).isNotNull())
        found = done if found is None else found.unionByName(done)
        again = solved.where(F.col(key).isNull()).select("cluster_id")
        if again.isEmpty():
            return found
        obs, margin = settled(obs.join(again, "cluster_id", "left_semi")), 2 * margin


def only_moved(events: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Of ``relocate``'s events those that a solution has moved; or, of its phases, those of such events."""
    moved = events.where("moved")
    return moved if rows is None else rows.join(moved.select("event_id"), "event_id", "left_semi")


def catalog_observations(cat: Catalog, picks: DataFrame, o: Options, xcorr: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """``observations`` of a whole catalog; ``given``: clusters to keep to (event_id, cluster_id) instead of those of the neighbours."""
    usable = Catalog(cat.stations, cat.events, picks.where("group in ('P', 'S')"))
    chosen = select_neighbours(usable, o.selection)
    if given is None:
        return observations(cat, clusters(chosen)[1], picks, xcorr)
    same = chosen.join(given.select(F.col("event_id").alias("ref_id"), "cluster_id"), "ref_id").join(given.select(F.col("event_id").alias("neigh_id"), F.col("cluster_id").alias("_c")), "neigh_id").where("cluster_id = _c").drop("_c", "cluster_id")
    from ..operators.graph import oriented

    return observations(cat, oriented(same).join(given.select(F.col("event_id").alias("ref_id"), "cluster_id"), "ref_id"), picks, xcorr)


def relocate_catalog(cat: Catalog, picks: DataFrame, o: Options, xcorr: DataFrame | None = None, given: DataFrame | None = None, result: str = RESULT) -> DataFrame:
    """The whole catalog: neighbours, clusters, then each cluster's solution. picks: phases with group and class_weight; xcorr: a cache as
    ``xcorr.correlate_edges`` makes it."""
    return relocate(catalog_observations(cat, picks, o, xcorr, given), o, result=result)


def refine(cat: Catalog, picks: DataFrame, traces: DataFrame, o: Options, x: XcorrOptions, known: DataFrame | None = None) -> DataFrame:
    """A cache of lags for all neighbours of a catalog, from traces; picks as for ``xcorr.windowed_picks``."""
    usable = Catalog(cat.stations, cat.events, picks.where("group in ('P', 'S')"))
    return correlate_edges(select_neighbours(usable, o.selection), picks, cat.events, cat.stations, traces, x, known)


def single_edges(both: Catalog, new: DataFrame, o: Options) -> DataFrame:
    """Edges from new events (id) to events that aren't new: of the nearest, or by shells; events with too few have none."""
    edges = eligible_edges(both, o.selection)
    edges = settled(edges.join(new.withColumnRenamed("id", "ref_id"), "ref_id", "left_semi").join(new.withColumnRenamed("id", "neigh_id"), "neigh_id", "left_anti"))
    pairs = edges.groupBy("ref_id", "neigh_id").agg(F.first("distance").alias("distance"))
    pairs = nearest_first(pairs, o.selection.max_neighbours) if o.selection.in_nearest_mode else by_shells(pairs, both.events, o.selection)
    enough = pairs.groupBy("ref_id").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, o.selection.min_neighbours))
    return edges.join(pairs.select("ref_id", "neigh_id"), ["ref_id", "neigh_id"], "left_semi").join(enough.select("ref_id"), "ref_id", "left_semi")


def relocate_single(background: Catalog, event: Catalog, picks: DataFrame, o: Options, traces: DataFrame | None = None, x: XcorrOptions | None = None) -> DataFrame:
    """New events, each against a fixed background catalog, with lags if there are traces; events without enough neighbours aren't returned."""
    both = Catalog(background.stations, background.events.unionByName(event.events, allowMissingColumns=True), picks.where("group in ('P', 'S')"))
    edges = single_edges(both, event.events.select("id"), o)
    cache = correlate_edges(edges, picks, both.events, both.stations, traces, x or XcorrOptions()) if traces is not None else None
    obs = observations(both, edges.withColumn("cluster_id", F.col("ref_id")), picks, cache)
    return relocate(obs, o, free=False).where("moved")


def relocate_in_two_steps(background: Catalog, event: Catalog, picks: DataFrame, o: Options, traces: DataFrame | None = None, x: XcorrOptions | None = None) -> DataFrame:
    """New events: first without lags, by neighbours that are no farther away than the stations; then from where that leads to, by the neighbours
    of one ellipsoid, with lags. The second step is tried for all; its result counts, with the rms that the first began with."""
    first = settled(relocate_single(background, event, picks, replace(o, selection=replace(o.selection, min_ratio=1.0))))
    moved = event.events.join(first.select(F.col("event_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("latitude", "longitude", "depth", "t_us")]), "id", "left")
    moved = moved.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("latitude", "longitude", "depth", "t_us")}).select(event.events.columns)
    second = relocate_single(background, Catalog(event.stations, settled(moved), event.phases), picks, replace(o, selection=replace(o.selection, shells=1)), traces, x)
    before = first.select("event_id", F.col("start_rms").alias("_rms"))
    return second.join(before, "event_id", "left").withColumn("start_rms", F.coalesce("_rms", "start_rms")).drop("_rms")
