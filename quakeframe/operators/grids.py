"""Travel times, velocities and take-off angles from regular grids, 3-D or over distance and depth, that are tables.

A grid has a header row and a row for each node. Cells, made of nodes once, have the values of all their corners in a row and a number,
so a point meets its cell by equality, whatever the grid's size; nothing is kept open or in memory. A point meets all grids of its
station at once, and cells of times and angles in one shuffle where both kinds' grids have the same form. Velocities at the source and
take-off angles give the partials. What isn't found has a kind: NO_GRID (none near enough to the station), OUT_OF_GRID,
NEGATIVE (a corner of the time cell is below 0), or LOW_QUALITY (of an angle)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import settled
from .spatial import nearest_grid
from .travel_time import partials

TIME, VELOCITY, ANGLE = "time", "velocity", "angle"
FOUND, NO_GRID, OUT_OF_GRID, NEGATIVE, LOW_QUALITY = "ok", "no_grid", "out_of_grid", "negative", "low_quality"
#: ``group`` is P or S; ``three_d`` off: y is the distance from the source. Coordinates in km, those of the flat projection around lat0, lon0.
#: ``unit`` of velocities: km/s, m/s, s/km, or s (over a node's distance).
HEADER = "grid_id bigint, kind string, `group` string, three_d boolean, nx bigint, ny bigint, nz bigint, x0 double, y0 double, z0 double, dx double, dy double, dz double, lat0 double, lon0 double, rotation double, source_latitude double, source_longitude double, source_depth double, unit string"
_FORM = ("three_d", "nx", "ny", "nz", "x0", "y0", "z0", "dx", "dy", "dz", "lat0", "lon0", "rotation", "source_latitude", "source_longitude")


def make_cells(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grid_id, cell, v, a, quality): values, azimuths (of angles) and least quality of the corners, of nodes (grid_id, ix, iy, iz, value, azimuth, quality).
    Values are times in s, velocities in km/s, or dips (degrees from straight down); azimuths are those of the grid's axes. v[4 i + 2 j + k] is the corner i, j, k of a 3-D cell,
    v[2 j + k] of another."""
    h = headers.select("grid_id", "kind", "three_d", "nx", "ny", "nz", F.col("dy").alias("_step"), "unit")
    n = nodes.join(h, "grid_id")
    v = F.col("value")
    v = F.when(F.col("kind") != VELOCITY, v).when(F.col("unit") == "m/s", v / 1000.0).when(F.col("unit") == "s/km", 1.0 / v).when(F.col("unit") == "s", F.col("_step") / v).otherwise(v)
    corners = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    of = F.explode(F.array(*(F.struct(*(F.lit(c).alias(f"{n}") for n, c in zip("ijk", x, strict=True))) for x in corners)))
    n = n.withColumns({"_v": v, "_a": F.when(F.col("kind") == ANGLE, F.col("azimuth"))}).withColumn("_c", of).where("three_d or _c.i = 0")
    at = {x: F.col(f"i{x}") - F.col(f"_c.{c}") for x, c in zip("xyz", "ijk", strict=True)}
    n = n.withColumns({f"_{x}": F.when(F.col("three_d") | F.lit(x != "x"), e).otherwise(0) for x, e in at.items()})
    n = n.where("_x >= 0 and _y >= 0 and _z >= 0 and _y < ny - 1 and _z < nz - 1 and (not three_d or _x < nx - 1)")
    n = n.withColumn("cell", (F.col("_x") * (F.col("ny") - 1) + F.col("_y")) * (F.col("nz") - 1) + F.col("_z")).withColumn("_k", 4 * F.col("_c.i") + 2 * F.col("_c.j") + F.col("_c.k"))
    pick = lambda c: F.array(*(F.max(F.when(F.col("_k") == k, F.col(c))) for k in range(8)))
    return n.groupBy("grid_id", "cell").agg(pick("_v").alias("v"), pick("_a").alias("a"), F.min("quality").alias("quality"))


def assign(stations: DataFrame, headers: DataFrame, within_m: float) -> DataFrame:
    """(station_id, kind, group, grid_id): for stations (id, latitude, longitude, elevation) the grid of each kind and group whose source is
    nearest, if it is within some metres; velocities, which have no source, have one grid for each group."""
    found = headers.where(F.col("kind") == VELOCITY).groupBy("group").agg(F.min("grid_id").alias("grid_id"))
    found = stations.select(F.col("id").alias("station_id"), F.explode(F.array(F.lit("P"), F.lit("S"))).alias("group")).join(found, "group").select("station_id", F.lit(VELOCITY).alias("kind"), "group", "grid_id")
    numbered = stations.select("id", "latitude", "longitude", geo.station_depth(F.col("elevation")).alias("depth"))
    for kind in (TIME, ANGLE):
        for group in ("P", "S"):
            own = headers.where((F.col("kind") == kind) & (F.col("group") == group)).select(F.col("grid_id").alias("id"), F.col("source_latitude").alias("latitude"), F.col("source_longitude").alias("longitude"), F.col("source_depth").alias("depth"))
            near = nearest_grid(numbered, own, within_m)
            found = found.unionByName(near.select("station_id", F.lit(kind).alias("kind"), F.lit(group).alias("group"), "grid_id"))
    return found


def _placed(rows: DataFrame, kind: str) -> DataFrame:
    """rows with _{kind}, the station's grid of that kind (a struct of its number and form), and _lat, _lon, _dep: instead of that struct, with _{kind} before them,
    _id, the grid's number; _cell, that of the cell which holds the point; _x, _y and _z, fractions in it; _three_d and _rotation; and _missing, why there is no cell.
    Numbers of missing cells are below 0 and many, as rows with one key would all go to one part of a shuffle."""
    h = lambda c: F.col(f"_{kind}.{c}")
    x, y = geo.to_flat(F.col("_lat"), F.col("_lon"), h("lat0"), h("lon0"), h("rotation"))
    sx, sy = geo.to_flat(h("source_latitude"), h("source_longitude"), h("lat0"), h("lon0"), h("rotation"))
    flat = h("y0") if kind == VELOCITY else F.hypot(x - sx, y - sy)
    at = {"x": F.when(h("three_d"), x).otherwise(h("x0")), "y": F.when(h("three_d"), y).otherwise(flat), "z": F.col("_dep")}
    rows = rows.withColumns({f"_{n}": (e - h(f"{n}0")) / h(f"d{n}") for n, e in at.items()})
    inside = F.lit(True)
    for n in "xyz":
        inside &= F.col(f"_{n}").between(F.lit(0.0), h(f"n{n}") - 1.0) | (F.lit(n == "x") & ~h("three_d"))
    # the last grid line belongs to the cell before it
    rows = rows.withColumns({f"_{n}i": F.when(h("three_d") | F.lit(n != "x"), F.least(F.floor(f"_{n}"), h(f"n{n}") - 2)).otherwise(0) for n in "xyz"})
    cell = (F.col("_xi") * (h("ny") - 1) + F.col("_yi")) * (h("nz") - 1) + F.col("_zi")
    rows = rows.withColumns({"_cell": F.when(inside, cell), **{f"_{n}": F.col(f"_{n}") - F.col(f"_{n}i") for n in "xyz"}})
    none = -1 - F.pmod(F.xxhash64("station_id", "_lat", "_lon"), F.lit(10_000))
    missing = F.when(h("grid_id").isNull(), NO_GRID).when(F.col("_cell").isNull(), OUT_OF_GRID)
    found = {"id": h("grid_id"), "cell": F.coalesce("_cell", none), **{n: F.col(f"_{n}") for n in "xyz"}, "three_d": h("three_d"), "rotation": h("rotation"), "missing": missing}
    return rows.withColumns({f"_{kind}_{n}": c for n, c in found.items()}).drop(f"_{kind}", "_cell", *(f"_{n}{i}" for n in "xyz" for i in ("", "i")))


def _met(rows: DataFrame, cells: DataFrame, kind: str) -> DataFrame:
    """rows of ``_placed`` with those columns of cells (grid_id, cell, ...) that lie where the kind's grid has the point."""
    return rows.join(cells.withColumnsRenamed({"grid_id": f"_{kind}_id", "cell": f"_{kind}_cell"}), [f"_{kind}_id", f"_{kind}_cell"], "left")


def _corners(column: str) -> list[Column]:
    return [F.col(column)[k] for k in range(8)]


def _value(kind: str, v: list[Column]) -> Column:
    x, y, z = (F.col(f"_{kind}_{n}") for n in "xyz")
    return F.when(F.col(f"_{kind}_three_d"), geo.trilinear(x, y, z, v)).otherwise(geo.bilinear(y, z, *v[:4]))


@dataclass(frozen=True)
class GridTables:
    """Headers and cells of grids and each station's grids, as a travel time spec. The three tables should be written ones. ``least_quality`` of angles."""

    headers: DataFrame
    cells: DataFrame
    assigned: DataFrame
    least_quality: int = 0

    @cached_property
    def places(self) -> DataFrame:
        """(station_id, group, _time, _velocity, _angle): each station's grids, with number and form; written, so that Spark knows how small it is."""
        own = self.assigned.join(self.headers.select("grid_id", *_FORM), "grid_id")
        grid = F.struct("grid_id", *_FORM)
        return settled(own.groupBy("station_id", "group").agg(*(F.first(F.when(F.col("kind") == k, grid), ignorenulls=True).alias(f"_{k}") for k in (TIME, VELOCITY, ANGLE))))

    @cached_property
    def velocities(self) -> DataFrame:
        """Cells of velocities: as they are of few grids, in a table of their own."""
        return settled(self._cells_of(VELOCITY).select("grid_id", "cell", F.col("v").alias("_v")))

    @cached_property
    def alike(self) -> bool:
        """Whether each time grid goes with no more than one angle grid, and that has its form: a point is in the same cell of both."""
        both = self.places.where("_time is not null and _angle is not null")
        same = reduce(and_, (F.col(f"_time.{c}").eqNullSafe(F.col(f"_angle.{c}")) for c in _FORM))
        own = both.groupBy("_time.grid_id").agg(F.min("_angle.grid_id").alias("first"), F.max("_angle.grid_id").alias("last"), F.bool_and(same).alias("same"))
        return own.where("first <> last or not same").isEmpty()

    def _cells_of(self, kind: str) -> DataFrame:
        return self.cells.join(self.headers.where(F.col("kind") == kind).select("grid_id"), "grid_id", "left_semi")

    def compute(self, points: DataFrame) -> DataFrame:
        """points (station_id, group, _lat, _lon, _dep of the event, _slat, _slon of the station, ...) with travel_time, azimuth, dip, dtdd, dtdh, and
        ``found``, which says why the others are NULL. Without a 3-D angle the azimuth is that to the station."""
        columns = points.columns
        to_station = geo.normalize_azimuth(F.degrees(geo.azimuth(*[F.col(c) for c in ("_lat", "_lon", "_slat", "_slon")])))
        rows = points.withColumn("_to", to_station).join(self.places, ["station_id", "group"], "left")
        rows = _placed(_placed(rows, TIME), VELOCITY)
        if self.alike:
            # by the number of the time grid they go with, so that times' and angles' cells meet points in one shuffle
            at, pairs = TIME, self.places.select(F.col("_angle.grid_id").alias("grid_id"), F.col("_time.grid_id").alias("_with")).dropna().distinct()
            angles = self.cells.join(pairs, "grid_id").drop("grid_id").withColumnRenamed("_with", "grid_id")
            rows = rows.withColumn("_angle_missing", F.when(F.col("_angle").isNull(), NO_GRID)).drop("_angle")
        else:
            at, angles, rows = ANGLE, self._cells_of(ANGLE), _placed(rows, ANGLE)
        carried = [*columns, "_to", *(c for c in rows.columns if c.startswith((f"_{TIME}_", f"_{ANGLE}_")))]
        rows = _met(rows, self.velocities, VELOCITY).select(*carried, _value(VELOCITY, _corners("_v")).alias("_velocity"), "_velocity_missing")
        rows = _met(rows, self._cells_of(TIME).select("grid_id", "cell", F.col("v").alias("_tv")), TIME)
        rows = rows.withColumns({"_time": _value(TIME, _corners("_tv")), "_negative": F.when(F.least(*_corners("_tv")) < 0, NEGATIVE)}).drop("_tv")
        rows = _met(rows, angles.select("grid_id", "cell", F.col("v").alias("_av"), F.col("a").alias("_aa"), F.col("quality").alias("_quality")), at)
        turned = geo.trilinear_angle(*(F.col(f"_{at}_{n}") for n in "xyz"), _corners("_aa"))
        rows = rows.withColumns({"_angle": _value(at, _corners("_av")), "_azimuth": F.when(F.col(f"_{at}_three_d"), geo.from_map_angle(turned, F.col(f"_{at}_rotation")))})
        bad = F.when(F.col("_quality") < self.least_quality, LOW_QUALITY)
        rows = rows.withColumn("found", F.coalesce("_time_missing", "_negative", "_velocity_missing", "_angle_missing", bad, F.lit(FOUND)))
        if_found = lambda c: F.when(F.col("found") == FOUND, c)
        dip = F.radians(F.col("_angle") - 90.0)
        return rows.select(
            *columns, "found", if_found(F.col("_time")).alias("travel_time"), if_found(F.coalesce("_azimuth", "_to")).alias("azimuth"), if_found(F.col("_angle")).alias("dip"),
            if_found(F.cos(dip) / geo.km2deg(F.col("_velocity"))).alias("dtdd"), if_found(F.sin(dip) / F.col("_velocity")).alias("dtdh"),
        )

    def timed(self, rows: DataFrame) -> DataFrame:
        """rows (latitude, longitude, depth, station_id, st_lat, st_lon, group, left) of a relocation with residual, dx, dy and dz (up)."""
        names = {"latitude": "_lat", "longitude": "_lon", "depth": "_dep", "st_lat": "_slat", "st_lon": "_slon"}
        found = self.compute(rows.withColumns({v: F.col(k) for k, v in names.items()}))
        return found.withColumns({"residual": F.col("left") - F.col("travel_time"), **partials(F.col("azimuth"), F.col("dtdd"), F.col("dtdh"))})

    def around(self, obs: DataFrame, margin_km: float) -> DataFrame:
        """(cluster_id, station_id, group, and header and cells of one grid): the cells of each cluster's grids not farther than ``margin_km``, and a cell,
        from its events; for relocations that solve a cluster in a task. A 2-D grid's cells are taken for the distances that the box around the
        events may have."""
        ends = None
        for k in (1, 2):
            own = obs.select("cluster_id", "station_id", "group", "st_lat", "st_lon", *[F.col(f"{c}{k}").alias(f"_{n}") for c, n in (("latitude", "lat"), ("longitude", "lon"), ("depth", "dep"))])
            ends = own if ends is None else ends.unionByName(own)
        box = ends.groupBy("cluster_id").agg(*[f(c).alias(f"{n}{c}") for c in ("_lat", "_lon", "_dep") for n, f in (("lo", F.min), ("hi", F.max))], F.min(F.pmod(F.col("_lon"), F.lit(360.0))).alias("lo360"), F.max(F.pmod(F.col("_lon"), F.lit(360.0))).alias("hi360"))
        # over the date line the box is narrower in 0 to 360 degrees
        wide = (F.col("hi_lon") - F.col("lo_lon")) > (F.col("hi360") - F.col("lo360"))
        box = box.withColumns({"lo_lon": F.when(wide, F.col("lo360")).otherwise(F.col("lo_lon")), "hi_lon": F.when(wide, F.col("hi360")).otherwise(F.col("hi_lon"))}).drop("lo360", "hi360")
        keys = ends.select("cluster_id", "station_id", "group", "st_lat", "st_lon").distinct().join(box, "cluster_id")
        rows = keys.join(self.assigned, ["station_id", "group"]).join(self.headers.drop("kind", "group", "unit", "source_depth"), "grid_id")
        corners = [geo.to_flat(F.col(f"{a}_lat"), F.col(f"{b}_lon"), F.col("lat0"), F.col("lon0"), F.col("rotation")) for a in ("lo", "hi") for b in ("lo", "hi")]
        xs, ys = ([c[i] for c in corners] for i in (0, 1))
        sx, sy = geo.to_flat(F.col("source_latitude"), F.col("source_longitude"), F.col("lat0"), F.col("lon0"), F.col("rotation"))
        middle = F.hypot((F.least(*xs) + F.greatest(*xs)) / 2 - sx, (F.least(*ys) + F.greatest(*ys)) / 2 - sy)
        half = F.hypot(F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)) / 2
        flat = F.col("kind") == VELOCITY
        span = {
            "x": (F.least(*xs), F.greatest(*xs)),
            "y": (F.when(F.col("three_d"), F.least(*ys)).when(flat, F.col("y0")).otherwise(middle - half), F.when(F.col("three_d"), F.greatest(*ys)).when(flat, F.col("y0")).otherwise(middle + half)),
            "z": (F.col("lo_dep"), F.col("hi_dep")),
        }
        for n, (lo, hi) in span.items():
            last = F.col(f"n{n}") - 2
            first, end = ((F.floor((e - F.col(f"{n}0")) / F.col(f"d{n}"))) for e in (lo - margin_km, hi + margin_km))
            line = F.sequence(F.least(F.greatest(first - 1, F.lit(0)), last), F.least(F.greatest(end + 1, F.lit(0)), last))
            rows = rows.withColumn(f"_{n}", F.explode(F.when(F.col("three_d") | F.lit(n != "x"), line).otherwise(F.array(F.lit(0).cast("bigint")))))
        cell = ((F.col("_x") * (F.col("ny") - 1) + F.col("_y")) * (F.col("nz") - 1) + F.col("_z")).alias("cell")
        return rows.select("cluster_id", "station_id", "group", "kind", "grid_id", cell, "st_lat", "st_lon", *_FORM).join(self.cells, ["grid_id", "cell"])


class Beyond(Exception):
    """A point left the cells that were sent, but not its grid."""


def array_times(sent: pd.DataFrame, least_quality: int):
    """A relocation's travel times from ``GridTables.around``'s rows of one cluster, on arrays. Raises Beyond where more cells are needed."""
    grids = {}
    for (lat, lon, group, kind), own in sent.groupby(["st_lat", "st_lon", "group", "kind"]):
        own = own.drop_duplicates("cell").sort_values("cell")
        grids[lat, lon, group, kind] = (own.iloc[0], own.cell.to_numpy(), np.array(own.v.tolist(), float), np.array([[np.nan if y is None else y for y in x] for x in own.a], float), own.quality.to_numpy(float))

    def flat(lat, lon, h):
        x = ((lon - h.lon0 + 180.0) % 360.0 - 180.0) * geo.FLAT_KM * np.cos(np.radians(lat))
        y = (lat - h.lat0) * geo.FLAT_KM
        c, s = np.cos(np.radians(h.rotation)), np.sin(np.radians(h.rotation))
        return x * c + y * s, y * c - x * s

    def value(grid, kind, lat, lon, depth):
        h, numbers, v, a, quality = grid
        x, y = flat(lat, lon, h)
        if not h.three_d:
            sx, sy = flat(np.array(h.source_latitude), np.array(h.source_longitude), h)
            x, y = np.full(len(lat), h.x0), np.full(len(lat), h.y0) if kind == VELOCITY else np.hypot(x - sx, y - sy)
        off = [(p - h[f"{n}0"]) / h[f"d{n}"] for n, p in zip("xyz", (x, y, depth), strict=True)]
        inside = np.ones(len(lat), bool)
        for n, p in zip("xyz", off, strict=True):
            inside &= (p >= 0) & (p <= h[f"n{n}"] - 1) if h.three_d or n != "x" else True
        at = [np.clip(np.floor(p), 0, h[f"n{n}"] - 2).astype(np.int64) if h.three_d or n != "x" else np.zeros(len(lat), np.int64) for n, p in zip("xyz", off, strict=True)]
        cell = (at[0] * (h.ny - 1) + at[1]) * (h.nz - 1) + at[2]
        row = np.minimum(np.searchsorted(numbers, cell), len(numbers) - 1)
        if (inside & (numbers[row] != cell)).any():
            raise Beyond
        f = [p - q for p, q in zip(off, at, strict=True)]
        weights = [(f[1] if k & 2 else 1 - f[1]) * (f[2] if k & 1 else 1 - f[2]) * ((f[0] if k & 4 else 1 - f[0]) if h.three_d else 1.0) for k in range(8 if h.three_d else 4)]
        mix = lambda c: sum(w * c[row, k] for k, w in enumerate(weights))
        out = np.where(inside, mix(v), np.nan)
        if kind == TIME:
            out = np.where((v[row][:, : len(weights)] < 0).any(axis=1), np.nan, out)
        r = np.radians(a)
        az = np.arctan2(mix(np.sin(r)), mix(np.cos(r))) - np.radians(h.rotation) if kind == ANGLE and h.three_d else np.full(len(lat), np.nan)
        return np.where(quality[row] < least_quality, np.nan, out) if kind == ANGLE else out, az

    def times(lat, lon, depth, station, group):
        tt, slope = np.full(len(lat), np.nan), np.full((len(lat), 3), np.nan)
        names = pd.MultiIndex.from_arrays([station[:, 0], station[:, 1], group])
        codes, known = names.factorize()
        for c, key in enumerate(known):
            own = np.flatnonzero(codes == c)
            if any((*key, kind) not in grids for kind in (TIME, VELOCITY, ANGLE)):
                continue
            p, q, d = lat[own], lon[own], depth[own]
            t, _ = value(grids[(*key, TIME)], TIME, p, q, d)
            v, _ = value(grids[(*key, VELOCITY)], VELOCITY, p, q, d)
            dip, az = value(grids[(*key, ANGLE)], ANGLE, p, q, d)
            f1, f2, dl = np.radians(p), np.radians(key[0]), np.radians(key[1] - q)
            az = np.where(np.isnan(az), np.arctan2(np.sin(dl) * np.cos(f2), np.cos(f1) * np.sin(f2) - np.sin(f1) * np.cos(f2) * np.cos(dl)), az)
            down = np.radians(dip - 90.0)
            tt[own] = np.where(np.isnan(v) | np.isnan(dip), np.nan, t)
            slope[own] = np.stack([-np.sin(az) * np.cos(down) / v, -np.cos(az) * np.cos(down) / v, -np.sin(down) / v], 1)
        return tt, slope

    return times
