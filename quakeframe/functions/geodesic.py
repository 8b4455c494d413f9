"""Shortest lines on an ellipsoid: the inverse problem by iteration on the auxiliary sphere, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Equatorial radius in m and flattening of WGS84.
A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)


def _iterated(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, most: int = 200) -> np.ndarray:
    """m; NaN where the iteration doesn't settle, as for points nearly opposite each other."""
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(p))) for p in (lat1, lat2))
    length = np.radians((lon2 - lon1 + 180.0) % 360.0 - 180.0)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, out = length.copy(), np.full(len(length), np.nan)
    open_ = np.arange(len(length))
    with np.errstate(all="ignore"):
        for _ in range(most):
            i, sl, cl = open_, np.sin(lam[open_]), np.cos(lam[open_])
            ss = np.hypot(c2[i] * sl, c1[i] * s2[i] - s1[i] * c2[i] * cl)
            cs = s1[i] * s2[i] + c1[i] * c2[i] * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1[i] * c2[i] * sl / np.where(ss == 0, 1.0, ss))
            ca2 = 1 - sa * sa
            cm = np.where(ca2 <= 1e-15, 0.0, cs - 2 * s1[i] * s2[i] / np.where(ca2 <= 1e-15, 1.0, ca2))
            c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
            new = length[i] + (1 - c) * FLAT * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            done = np.abs(new - lam[i]) < 1e-12
            k = ca2 * (A * A - B * B) / (B * B)
            big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
            small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
            turn = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
            out[i[done]] = (B * big * (sigma - turn))[done]
            lam[i] = new
            # beyond half a turn the line would go round the other side: it isn't the shortest, and won't settle
            open_ = i[~done & (np.abs(new) <= np.pi)]
            if not len(open_):
                break
    return out


def inverse_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Distances in m on the ellipsoid. Where the iteration doesn't settle the shortest line has a middle point a quarter of the way round, and the
    sum of the ways to it and from it is least there: it is sought in ever smaller steps of direction."""
    known = np.isfinite(lat1 + lon1 + lat2 + lon2)
    out = np.full(len(lat1), np.nan)
    out[known] = _iterated(*(x[known] for x in (lat1, lon1, lat2, lon2)))
    for i in np.flatnonzero(known & np.isnan(out)):
        middle, half, f = 0.0, np.pi, np.radians(lat1[i])
        for _ in range(14):
            az = middle + np.linspace(-half, half, 73)
            lat = np.degrees(np.arcsin(np.clip(np.cos(f) * np.cos(az), -1, 1)))
            lon = lon1[i] + np.degrees(np.arctan2(np.sin(az) * np.cos(f), -np.sin(f) * np.sin(np.radians(lat))))
            same = np.ones(len(az))
            way = _iterated(same * lat1[i], same * lon1[i], lat, lon) + _iterated(lat, lon, same * lat2[i], same * lon2[i])
            middle, half = az[np.nanargmin(way)], half / 12
        out[i] = np.nanmin(way)
    return out


@F.pandas_udf(DoubleType())
def _inverse(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(inverse_m(*(x.to_numpy(float) for x in (lat1, lon1, lat2, lon2))))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """m between two points of the WGS84 ellipsoid; NULL if a coordinate is."""
    found = _inverse(lat1, lon1, lat2, lon2)
    return F.when(~F.isnan(found), found)
