"""Spatial joins on hypocentres: cells of a cube around the earth, joined on equality.

Points on the unit sphere that are closer than an angle differ by no more than its chord in each coordinate. With cells of that
side, neighbours are in the same cell or in one of the 26 around it; one side is given to all of them that meet the sphere. It holds at
the poles and across the date line, and plans as a hash or merge join. Rows of one table meet in half of these cells, each pair once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..tables import settled


class Fold(Protocol):
    """What a task makes of the pairs that ``folded_within`` gives it."""

    def add(self, one: np.ndarray, two: np.ndarray, mm: np.ndarray) -> None: ...

    def rows(self) -> Iterator[pa.RecordBatch]: ...


def _with_xyz(points: DataFrame, end: str, id_name: str) -> DataFrame:
    """id, latitude, longitude and depth with ``end`` behind their names, and the point on the unit sphere, once for each row."""
    f, l0 = F.radians("latitude"), F.radians("longitude")
    unit = {"ux": F.cos(f) * F.cos(l0), "uy": F.cos(f) * F.sin(l0), "uz": F.sin(f)}
    return points.select(F.col("id").alias(id_name), *[F.col(c).alias(f"{c}{end}") for c in ("latitude", "longitude", "depth")], *[c.alias(f"{n}{end}") for n, c in unit.items()])


def _deepest(*tables: DataFrame) -> float:
    """Greatest depth, as distances on the surface shrink with it."""
    found = [t.agg(F.max("depth")).first()[0] for t in tables]
    deepest = max([0.0, *(d for d in found if d is not None)])
    if deepest >= geo.EARTH_KM:
        raise ValueError(f"a depth of {deepest} km is below the earth's centre")
    return deepest


def _side(km: float, deepest: float) -> float:
    """Chord on the unit sphere that points within ``km`` don't exceed in any coordinate."""
    return 2.0 * math.sin(min(km / (geo.EARTH_KM - deepest), math.pi) / 2.0) * (1 + 1e-9)


def _line2(deepest: float) -> Column:
    """Square of a length in km that the distance of points 1 and 2 is never below."""
    chord2 = sum((geo.square(F.col(f"u{n}1") - F.col(f"u{n}2")) for n in "xyz"), F.lit(0.0))
    return chord2 * (geo.EARTH_KM - deepest) ** 2 + geo.square(F.col("depth1") - F.col("depth2"))


def _dealt(left: DataFrame) -> DataFrame:
    """left in as many parts as a shuffle has: a small file is one task, and few bytes would be put together again, but its rows' pairs are many."""
    return left.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a_id")


def _around(left: DataFrame, side: float, behind: int = 1) -> DataFrame:
    """left once for each cell x, y, z around its own that meets the sphere, as no row lies in the others; ``behind``: 0 leaves out those before its own in x."""
    for n in "xyz":
        own = F.floor(F.col(f"u{n}1") / side)
        left = left.withColumn(n, F.explode(F.sequence(own - (behind if n == "x" else 1), own + 1)))
    ends = [[f(F.abs(F.col(n)), F.abs(F.col(n) + 1)) * side for n in "xyz"] for f in (F.least, F.greatest)]
    inner, outer = (sum((geo.square(c) for c in cs), F.lit(0.0)) for cs in ends)
    return left.where((inner <= 1 + 1e-9) & (outer >= 1 - 1e-9))


def _near(left: DataFrame, right: DataFrame, km: float, deepest: float) -> DataFrame:
    """Pairs of rows of ``_with_xyz`` that may lie within ``km``: joined on cells, then held to the straight line between them,
    a few products for each pair, before any angle is computed."""
    side = _side(km, deepest)
    left = _around(_dealt(left), side)
    right = right.withColumns({n: F.floor(F.col(f"u{n}2") / side) for n in "xyz"})
    same = [left[n] == right[n] for n in "xyz"]
    return left.join(right, same[0] & same[1] & same[2] & (_line2(deepest) <= km * km * (1 + 1e-9) + 1e-9)).drop(*"xyz")


#: Candidates that ``folded_within`` looks at together, which a processor's cache holds.
_SWEPT = 1 << 16
#: Cells along an edge of the cube before their numbers come again; rows that meet by that are too far apart.
_EDGE = 1 << 20


def _cell(*n: Column) -> Column:
    """One number of a cell x, y, z; the cells around one have different ones."""
    x, y, z = (F.pmod(c, F.lit(_EDGE)) for c in n)
    return (x * _EDGE + y) * _EDGE + z


def _crowded(cells: DataFrame, parts: int) -> DataFrame:
    """cell, split: cells with four parts' share of all pairs or more, each to be split into split * split of ``parts``; no more than a fourth of ``parts`` rows."""
    n = cells.groupBy("cell").agg(F.count("*").cast("double").alias("n"))
    share = geo.square(F.col("n")) * (parts / (n.agg(F.sum(geo.square(F.col("n")))).first()[0] or 1.0))
    return n.where(share >= 4).select("cell", F.floor(F.sqrt(share)).alias("split"))


def _dealt_once(points: DataFrame, km: float, deepest: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows of one table as left and right ends of pairs that may lie within ``km``, and the columns that both ends share. A left row is given to its own cell, where ids are in
    order (``own``), and to those after it, some seven copies of it in all; a crowded cell takes as many parts of a shuffle as its share of all pairs is."""
    side, parts = _side(km, deepest), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = _with_xyz(points, "1", "a_id"), _with_xyz(points, "2", "b_id")
    own = [F.floor(F.col(f"u{n}1") / side) for n in "xyz"]
    right = right.withColumn("cell", _cell(*(F.floor(F.col(f"u{n}2") / side) for n in "xyz")))
    left = _around(left, side, 0).where(F.struct(*"xyz") >= F.struct(*own)).withColumns({"cell": _cell(*map(F.col, "xyz")), "own": F.struct(*"xyz") == F.struct(*own)}).drop(*"xyz")
    crowded = F.broadcast(_crowded(right, parts))
    some, split = F.coalesce("split", F.lit(1)), F.sequence(F.lit(0), F.coalesce("split", F.lit(1)) - 1)
    left = left.join(crowded, "cell", "left").withColumns({"i": F.pmod(F.hash("a_id"), some), "j": F.explode(split)})
    right = right.join(crowded, "cell", "left").withColumns({"j": F.pmod(F.hash("b_id"), some), "i": F.explode(split)})
    return left.drop("split"), right.drop("split"), ["cell", "i", "j"]


def _each_once(points: DataFrame, km: float, deepest: float) -> DataFrame:
    """Pairs of rows of one table, of different ids, that may lie within ``km``, each once. Pairs are made in all parts of a shuffle and never sorted or shuffled themselves."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right, on = _dealt_once(points, km, deepest)
    left, right = (t.repartition(parts, *on) for t in (left, right))
    same = (left["cell"] == right["cell"]) & (left["i"] == right["i"]) & (left["j"] == right["j"])
    apart = F.when(F.col("own"), F.col("a_id") < F.col("b_id")).otherwise(F.col("a_id") != F.col("b_id"))
    return left.join(right.hint("merge"), same & apart & (_line2(deepest) <= km * km * (1 + 1e-9) + 1e-9)).drop(*on, "own")


def folded_within(points: DataFrame, km: float, fold: Callable[[], Fold], schema: str) -> DataFrame:
    """For the pairs that ``neighbours_within`` has, each once, what a task's ``fold`` makes of them: it is given arrays of both ids (whole numbers) and of distances in mm,
    rounded to whole ones as ``floor(distance * 1e6 + 0.5)``, some ten thousands of pairs at a time, and gives batches of rows at its end.

    Ends meet in their cells as arrays, in order of one coordinate. Distances come from the chord, to some 1e-11 km; those that a rounding or ``km`` decides are worked out as ``geo.distance3d``."""
    deepest, parts = _deepest(points), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right, on = _dealt_once(points, km, deepest)
    names = ["id", "latitude", "longitude", "depth", "ux", "uy", "uz"]
    ends = [t.select(*on, flag.alias("end"), F.col(own).alias("id"), *[F.col(f"{n}{k}").alias(n) for n in names[1:]]) for t, flag, own, k in ((right, F.lit(0), "b_id", 2), (left, F.when(F.col("own"), 2).otherwise(1), "a_id", 1))]
    rows = ends[0].unionByName(ends[1]).repartition(parts, *on).sortWithinPartitions(*on)
    scale, side, straight = geo.EARTH_KM - deepest, _side(km, deepest), km * km * (1 + 1e-9) + 1e-9

    def exact(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """As ``geo.distance3d``, of columns latitude, longitude, depth."""
        dlat, dlon = np.radians(q[0] - p[0]), np.radians(q[1] - p[1])
        a = np.clip(np.sin(dlat / 2) ** 2 + np.cos(np.radians(p[0])) * np.cos(np.radians(q[0])) * np.sin(dlon / 2) ** 2, 0.0, 1.0)
        angle = np.where((np.abs(p[0] - q[0]) < geo.SAME) & (np.abs(dlon) < geo.SAME), 0.0, 2.0 * np.arcsin(np.sqrt(a)))
        return np.sqrt((angle * (geo.EARTH_KM - (p[2] + q[2]) / 2)) ** 2 + (p[2] - q[2]) ** 2)

    def sweep(t: pa.RecordBatch, into: Fold) -> None:
        """All pairs of one group."""
        end, ids = t.column("end").to_numpy(), t.column("id").to_numpy()
        at = np.stack([t.column(n).to_numpy() for n in names[1:]])
        unit = at[3:] * scale
        r = np.flatnonzero(end == 0)
        if not len(r) or len(r) == len(end):
            return
        axis = int(np.argmax(np.ptp(unit[:, r], axis=1)))
        r = r[np.argsort(unit[axis, r])]
        x, y, z, along, depth, b_ids, b_at = *unit[:, r], unit[axis, r], at[2, r], ids[r], at[:3, r]
        a = np.flatnonzero(end > 0)
        a = a[np.argsort(unit[axis, a])]
        reach, height = side * scale + 1e-6, max(1, min(256, _SWEPT // len(r)))
        for lo in range(0, len(a), height):
            rows = a[lo : lo + height]
            first, last = np.searchsorted(along, [unit[axis, rows[0]] - reach, unit[axis, rows[-1]] + reach])
            for w in range(first, last, _SWEPT):
                w = slice(w, min(w + _SWEPT, last))
                d = unit[0, rows, None] - x[w]
                line = d * d
                for c, own in ((y, 1), (z, 2)):
                    d = unit[own, rows, None] - c[w]
                    d *= d
                    line += d
                d = at[2, rows, None] - depth[w]
                d *= d
                line += d
                may = line <= straight
                i, j = np.nonzero(may)
                line, i, j = line[may], rows[i], j + w.start
                one, two = ids[i], b_ids[j]
                keep = np.where(end[i] == 2, one < two, one != two)
                line, i, j, one, two = line[keep], i[keep], j[keep], one[keep], two[keep]
                dz = at[2, i] - depth[j]
                dz *= dz
                line -= dz
                line /= scale * scale  # the chord's square
                angle = 2.0 * np.arcsin(np.sqrt(np.clip(line, 0.0, 4.0)) / 2) if km > 50 else np.sqrt(np.maximum(line, 0.0) * (1 + line * (1 / 12 + line * (1 / 90 + line / 560))))
                angle *= geo.EARTH_KM - (at[2, i] + depth[j]) / 2
                km_ = np.sqrt(angle * angle + dz)
                mm = km_ * 1e6 + 0.5
                doubt = np.flatnonzero((np.abs(mm - np.rint(mm)) < (1e-3 if km <= 50 else 1.0)) | (km_ > km - 1e-6))
                if len(doubt):
                    km_[doubt] = exact(at[:3, i[doubt]], b_at[:, j[doubt]])
                    mm[doubt] = km_[doubt] * 1e6 + 0.5
                    if (km_[doubt] > km).any():
                        keep = km_ <= km
                        one, two, mm = one[keep], two[keep], mm[keep]
                into.add(one, two, np.floor(mm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, held, last = fold(), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in on], axis=1)
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cuts = [0, *new.tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and tuple(keys[lo]) != last:
                    sweep(pa.concat_batches(held), into)
                    held = []
                last = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            sweep(pa.concat_batches(held), into)
        yield from into.rows()

    return rows.mapInArrow(run, schema)


def _measured(pairs: DataFrame, flat: bool) -> DataFrame:
    args = [F.col(c) for c in ("latitude1", "longitude1", "latitude2", "longitude2")]
    d = geo.distance(*args, F.col("depth1")) if flat else geo.distance3d(args[0], args[1], F.col("depth1"), args[2], args[3], F.col("depth2"))
    return pairs.withColumn("distance", d)


def radius_pairs(a: DataFrame, b: DataFrame, km: float, flat: bool = False) -> DataFrame:
    """Pairs of a row of a and of b (id, latitude, longitude, depth) not more than ``km`` apart: a_id, b_id, distance.

    ``flat`` measures horizontally, at a's depth."""
    left, right = _with_xyz(a, "1", "a_id"), _with_xyz(b, "2", "b_id")
    deepest = _deepest(a, b)
    if flat:
        right = right.withColumn("depth2", F.lit(0.0))
        pairs = _near(left.withColumns({"depth": F.col("depth1"), "depth1": F.lit(0.0)}), right, km, deepest).withColumn("depth1", F.col("depth"))
    else:
        pairs = _near(left, right, km, deepest)
    return _measured(pairs, flat).where(F.col("distance") <= km).select("a_id", "b_id", "distance")


def neighbours_within(events: DataFrame, km: float, digits: int | None = None) -> DataFrame:
    """Directed pairs of different events: ref_id, neigh_id, distance. Each pair is measured, and with ``digits`` rounded, once and given both ways.

    Distances are compared, before they are rounded, after both ways are made: a filter before would be taken into the join, and they would be measured twice."""
    pairs = _measured(_each_once(events, km, _deepest(events)), False).select("a_id", "b_id", "distance")
    pairs = pairs.withColumn("shown", F.col("distance") if digits is None else F.round("distance", digits))
    ways = F.inline(F.array(*(F.struct(F.col(a).alias("ref_id"), F.col(b).alias("neigh_id"), "distance", "shown") for a, b in (("a_id", "b_id"), ("b_id", "a_id")))))
    return pairs.select(ways).where(F.col("distance") <= km).select("ref_id", "neigh_id", F.col("shown").alias("distance"))


#: Bands of latitude, each as wide as rows may lie apart, that a group's rows are dealt by.
_BANDS = 8
#: Candidates that a task of ``sharing_within`` looks at together.
_AT_ONCE = 1 << 19


def _inside(h: np.ndarray, dz: np.ndarray, across: float, along: float) -> np.ndarray:
    """As ``geo.in_ellipsoid``, of distances across and depths below the centre."""
    if along == 0 or across == 0:
        return ((h == 0.0) if along == 0 else (h <= along)) & ((dz == 0.0) if across == 0 else (np.abs(dz) <= across))
    return (h / along) ** 2 + (dz / across) ** 2 <= 1.0


def sharing_within(rows: DataFrame, keys: list[str], km: float, columns: list[str] | None = None, ellipsoid: tuple[float, float] | None = None, events: DataFrame | None = None) -> DataFrame:
    """Pairs of rows (id, latitude, longitude, depth, keys, ...) of different ids that have equal keys and lie not more than ``km`` apart:
    keys, distance, and ``columns`` (or all others) with 1 and 2 behind their names. Each pair comes once, and ids in one order for all keys; rows of equal keys,
    id and latitude count once. With ``ellipsoid``, half axes (across, along) as ``geo.in_ellipsoid`` has them, ``in1`` tells whether 2 is inside of it around 1, ``in2`` whether 1 is around 2;
    pairs of which neither is are left out. ``events``: a table that has all of ``rows``' depths and costs less to look at.

    Rows are shuffled once, by their keys and wide bands of latitude; those near a band's upper end are given to the next one as well. In order of latitude a row
    meets those that follow it and aren't farther north than ``km``, so what is looked at grows with the keys' rows, not with all pairs of points that lie near each other."""
    deepest, parts = _deepest(rows if events is None else events), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in rows.columns if c not in keys] if columns is None else columns
    need = list(dict.fromkeys(["id", "latitude", "longitude", "depth", *columns]))
    step = math.degrees(min(km / (geo.EARTH_KM - deepest), math.pi)) * (1 + 1e-9) + 1e-9
    line2 = km * km * (1 + 1e-9) + 1e-9
    slab = lambda c: F.floor(c / (_BANDS * step))
    known = F.col("depth").isNotNull()
    for c in (*keys, "latitude", "longitude"):
        known &= F.col(c).isNotNull()
    dealt = rows.where(known).select(*keys, *need, slab(F.col("latitude")).alias("_own"))
    dealt = dealt.withColumn("_slab", F.explode(F.sequence("_own", slab(F.col("latitude") + step))))
    dealt = dealt.select(*keys, "_slab", (F.col("_own") == F.col("_slab")).alias("_own"), *need).repartition(parts, *keys, "_slab").sortWithinPartitions(*keys, "_slab", "latitude", "id")
    fields = {f.name: f.dataType for f in dealt.schema}
    schema = T.StructType([T.StructField(k, fields[k]) for k in keys])
    schema.add("distance", T.DoubleType())
    for k in "12":
        for c in columns:
            schema.add(f"{c}{k}", fields[c])
    for n in ("in1", "in2") if ellipsoid else ():
        schema.add(n, T.BooleanType())

    def pairs(t: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Those of whole groups, which end before these rows."""
        first = np.append(0, ends[:-1])
        lat, lon, depth = (t.column(c).to_numpy() for c in ("latitude", "longitude", "depth"))
        own, group = t.column("_own").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ends)), ends - first)
        f, l0 = np.radians(lat), np.radians(lon)
        cos = np.cos(f)
        unit = np.stack([cos * np.cos(l0), cos * np.sin(l0), np.sin(f)], axis=1) * (geo.EARTH_KM - deepest)
        at = group * 1024.0 + lat
        here = np.arange(len(lat))
        to = np.minimum(np.searchsorted(at, at + step + 1e-6, "right"), ends[group])
        n = to - here - 1
        total = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _AT_ONCE, "right")))
            i = np.repeat(here[lo:hi], n[lo:hi])
            j = np.arange(len(i)) + np.repeat(here[lo:hi] + 1 - (total[lo:hi] - n[lo:hi] - (total[lo - 1] if lo else 0)), n[lo:hi])
            lo = hi
            keep = own[j]
            i, j = i[keep], j[keep]
            d = unit[i] - unit[j]
            keep = np.einsum("ij,ij->i", d, d) + (depth[i] - depth[j]) ** 2 <= line2
            i, j = i[keep], j[keep]
            # as ``geo.distance3d``
            dlat, dlon = np.radians(lat[j] - lat[i]), np.radians(lon[j] - lon[i])
            a = np.clip(np.sin(dlat / 2) ** 2 + cos[i] * cos[j] * np.sin(dlon / 2) ** 2, 0.0, 1.0)
            angle = np.where((np.abs(lat[i] - lat[j]) < geo.SAME) & (np.abs(dlon) < geo.SAME), 0.0, 2.0 * np.arcsin(np.sqrt(a)))
            dz = depth[j] - depth[i]
            distance = np.sqrt((angle * (geo.EARTH_KM - (depth[i] + depth[j]) / 2)) ** 2 + dz * dz)
            keep = distance <= km
            around = ()
            if ellipsoid:
                around = [_inside(angle * (geo.EARTH_KM - depth[x]), dz, *ellipsoid) for x in (i, j)]
                keep &= around[0] | around[1]
            i, j, distance, around = i[keep], j[keep], distance[keep], [x[keep] for x in around]
            one, two = (t.column("id").take(pa.array(x)) for x in (i, j))
            swap = np.asarray(pc.greater(one, two))
            keep = np.asarray(pc.not_equal(one, two))
            if not keep.any():
                continue
            i, j = np.where(swap, j, i)[keep], np.where(swap, i, j)[keep]
            out = [t.column(k).take(pa.array(i)) for k in keys] + [pa.array(distance[keep])]
            out += [t.column(c).take(pa.array(x)) for x in (i, j) for c in columns]
            if ellipsoid:
                out += [pa.array(np.where(swap, x, y)[keep]) for x, y in (around[::-1], around)]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def changes(t: pa.RecordBatch, names: list[str]) -> np.ndarray:
            """Rows, from the second on, that differ from the one before in one of these."""
            found = np.zeros(max(0, t.num_rows - 1), bool)
            for c in names:
                x = t.column(c)
                found |= np.asarray(pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)), True))
            return found

        def give(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            same = ~changes(t, [*keys, "_slab", "latitude", "id"])
            if same.any():
                t = t.filter(pa.array(np.append(True, ~same)))
            yield from pairs(t, np.append(np.flatnonzero(changes(t, [*keys, "_slab"])) + 1, t.num_rows))

        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch]) if held else batch
            last = np.flatnonzero(changes(both, [*keys, "_slab"]))
            if not len(last):
                held.append(batch)
                continue
            cut = int(last[-1]) + (0 if held else 1)  # rows of this batch that belong to whole groups
            if held or cut:
                yield from give(pa.concat_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield from give(pa.concat_batches(held))

    return dealt.mapInArrow(run, schema)


def _reaching(left: DataFrame, right: DataFrame, km: float, deepest: float, low: float, high: float) -> DataFrame:
    """Pairs of rows of ``_with_xyz`` that may lie within ``reach`` of the left row, and no more than ``km`` from it across: joined on cells of the
    sphere and bands of depth, ``km`` wide. Right rows have depths from ``low`` to ``high``; left rows are dealt to cells that meet the sphere alone."""
    side, reach = _side(km, deepest), F.col("reach") * (1 + 1e-9) + 1e-9
    left = _around(_dealt(left), side)
    band = lambda c: F.floor(c / km)
    top, bottom = F.greatest(F.col("depth1") - reach, F.lit(low)), F.least(F.col("depth1") + reach, F.lit(high))
    left = left.withColumn("d", F.explode(F.sequence(band(top), F.greatest(band(top), band(bottom)))))
    right = right.withColumns({n: F.floor(F.col(f"u{n}2") / side) for n in "xyz"}).withColumn("d", band(F.col("depth2")))
    same = [left[n] == right[n] for n in "xyzd"]
    return left.join(right, same[0] & same[1] & same[2] & same[3] & (_line2(deepest) <= geo.square(reach))).drop(*"xyzd")


def first_radius(a: DataFrame, b: DataFrame, k: int) -> tuple[float, float, float, int]:
    """Radius in km within which a row of a may have some 2 k rows of b if these were spread evenly over their extent, b's depths, and its rows.

    b's rows may fill a volume or an area; seen from far above or below, those within a radius are the nearer of a thin layer."""
    ends = [f(c) for c in ("latitude", "longitude", "depth") for f in (F.min, F.max)]
    n, lat0, lat1, lon0, lon1, low, high, lat = b.agg(F.count("*"), *ends, F.avg("latitude")).first()
    if not n:
        return 1.0, 0.0, 0.0, 0
    gap = a.agg(F.avg(F.greatest(F.lit(0.0), low - F.col("depth"), F.col("depth") - high))).first()[0] or 0.0
    area = max(1e-9, (lat1 - lat0) * (lon1 - lon0) * math.cos(math.radians(lat))) * geo.FLAT_KM**2
    each, deep = 2 * k * area / n, high - low
    return max(1e-3, math.sqrt(each / math.pi), (each * deep * 0.75 / math.pi) ** (1 / 3), (2 * each * gap * deep / math.pi) ** 0.25), low, high, n


def nearest(a: DataFrame, b: DataFrame, k: int, start_km: float | None = None, most_km: float | None = None, others: bool = False) -> DataFrame:
    """The k nearest rows of b for each row of a (fewer if b has fewer): a_id, b_id, distance, rank; ties by b's id. ``most_km``: no farther
    than that; ``others``: not the row of the same id.

    The radius across, at first such that some 2 k rows of b lie within it if b were spread evenly over its extent, grows twofold for those
    that have too few within it. What is farther across is also farther than the radius and the depth between the row and all of b make together,
    so that is how far each row looks; what is asked for is never more than b has, so no round has to look all round the earth for rows
    that aren't there."""
    km, low, high, size = first_radius(a, b, k)
    w = Window.partitionBy("a_id").orderBy("distance", "b_id")
    least, deepest = min(k, size - others), _deepest(a, b)
    whole = math.pi * geo.EARTH_KM + 2 * deepest + 100.0
    most, km = min(whole, whole if most_km is None else most_km), km if start_km is None else start_km
    if least <= 0:
        return radius_pairs(a, b.where("false"), 1.0).withColumn("rank", F.lit(1))
    found, left, right = None, a.select("id", "latitude", "longitude", "depth"), _with_xyz(b, "2", "b_id")
    while True:
        km = min(km, most)
        gap = F.greatest(F.lit(0.0), low - F.col("depth1"), F.col("depth1") - high)
        # what lies in a band or a cell is within the radius; the last round of a bounded search takes all up to the bound
        reach = F.lit(most) if km >= most else F.least(F.sqrt(gap * gap + km * km), F.lit(most))
        pairs = _reaching(_with_xyz(left, "1", "a_id").withColumn("reach", reach), right, km, deepest, low, high)
        pairs = _measured(pairs.where("a_id <> b_id") if others else pairs, False).where("distance <= reach").select("a_id", "b_id", "distance")
        pairs = settled(pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= least))
        if km >= most:
            return pairs if found is None else found.unionByName(pairs)
        full = pairs.where(F.col("rank") == least).select(F.col("a_id").alias("id"))
        done = pairs.join(full.withColumnRenamed("id", "a_id"), "a_id", "left_semi")
        found = done if found is None else found.unionByName(done)
        left = settled(left.join(full, "id", "left_anti"))
        if left.isEmpty():
            return found
        km *= 2


def others_reached(left: DataFrame, events: DataFrame, km: float, deepest: float, low: float, high: float) -> DataFrame:
    """Pairs of a row of left and another of events that may lie within ``km``: a_id, b_id, distance, and latitude, longitude and depth
    with 1 and 2 behind their names; distances are left to be compared. Depths of events are between ``low`` and ``high`` and none is below ``deepest``."""
    pairs = _reaching(_with_xyz(left, "1", "a_id").withColumn("reach", F.lit(km)), _with_xyz(events, "2", "b_id"), km, deepest, low, high)
    return _measured(pairs.where("a_id <> b_id"), False)


def nearest_grid(stations: DataFrame, grids: DataFrame, within_m: float) -> DataFrame:
    """(station_id, grid_id, distance) of the grid whose source lies nearest to a station, if it is within some metres. A grid is
    looked for no farther away than that, so stations without one cost no wider search."""
    pairs = nearest(stations, grids, 1, most_km=within_m / 1000.0)
    return pairs.select(F.col("a_id").alias("station_id"), F.col("b_id").alias("grid_id"), "distance")


def nearest_within(events: DataFrame, km: float, k: int) -> DataFrame:
    """The k nearest other events within ``km`` of each: ref_id, neigh_id, distance; the rows that the k first of ``neighbours_within`` are."""
    return nearest(events, events, k, most_km=km, others=True).select(F.col("a_id").alias("ref_id"), F.col("b_id").alias("neigh_id"), "distance")
