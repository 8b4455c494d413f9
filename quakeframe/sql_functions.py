"""Geometry and neighbour selection as SQL functions, for queries that are written as text.

Scalar functions are SQL expressions that Spark puts in place of the call; ``nearest_rows`` is a table function of each partition of its
argument."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .functions.geo import EARTH_KM, SAME

_SAME = f"abs(lat1 - lat2) < {SAME!r} AND abs(radians(lon2 - lon1)) < {SAME!r}"
_PAIR = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"
_HALF = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
_ANGLE = f"CASE WHEN {_SAME} THEN 0D ELSE 2D * atan2(sqrt(greatest(0D, least(1D, {_HALF}))), sqrt(1D - greatest(0D, least(1D, {_HALF})))) END"
#: name, parameters, expression; degrees and km.
SCALARS = [
    ("quake_normalize_lon", "deg DOUBLE", "pmod(deg + 180D, 360D) - 180D"),
    ("quake_normalize_azimuth", "deg DOUBLE", "pmod(deg, 360D)"),
    ("quake_azimuth", _PAIR, f"CASE WHEN {_SAME} THEN 0D ELSE pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))), 360D) END"),
    ("quake_distance", f"{_PAIR}, depth DOUBLE", f"({_ANGLE}) * ({EARTH_KM!r}D - depth)"),
    ("quake_distance3", "lat1 DOUBLE, lon1 DOUBLE, depth1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, depth2 DOUBLE", f"sqrt(pow(({_ANGLE}) * ({EARTH_KM!r}D - (depth1 + depth2) / 2), 2) + pow(depth1 - depth2, 2))"),
    ("quake_km_to_degrees", "km DOUBLE, depth DOUBLE", f"km / (({EARTH_KM!r}D - depth) * {math.pi / 180!r}D)"),
    ("quake_bilinear", "x DOUBLE, y DOUBLE, v00 DOUBLE, v01 DOUBLE, v10 DOUBLE, v11 DOUBLE", "(v00 * (1 - y) + v01 * y) * (1 - x) + (v10 * (1 - y) + v11 * y) * x"),
    ("quake_mean_angle", "x DOUBLE, deg1 DOUBLE, deg2 DOUBLE", "pmod(degrees(atan2(sin(radians(deg1)) * (1 - x) + sin(radians(deg2)) * x, cos(radians(deg1)) * (1 - x) + cos(radians(deg2)) * x)), 360D)"),
]
#: Places in the sense of an azimuth from a place, as a struct of latitude and longitude.
PLACES = [
    (
        "quake_move", "lat DOUBLE, lon DOUBLE, km DOUBLE, deg DOUBLE, depth DOUBLE", "STRUCT<latitude: DOUBLE, longitude: DOUBLE>",
        f"""CASE WHEN km = 0D THEN named_struct('latitude', lat, 'longitude', lon) ELSE named_struct(
            'latitude', degrees(asin(sin(radians(lat)) * cos(km / ({EARTH_KM!r}D - depth)) + cos(radians(lat)) * sin(km / ({EARTH_KM!r}D - depth)) * cos(radians(deg)))),
            'longitude', pmod(lon + degrees(atan2(sin(radians(deg)) * sin(km / ({EARTH_KM!r}D - depth)) * cos(radians(lat)), cos(km / ({EARTH_KM!r}D - depth)) - sin(radians(lat)) * (sin(radians(lat)) * cos(km / ({EARTH_KM!r}D - depth)) + cos(radians(lat)) * sin(km / ({EARTH_KM!r}D - depth)) * cos(radians(deg))))) + 180D, 360D) - 180D) END""",
    ),
]


@udtf(returnType="ref_id bigint, neigh_id bigint, distance double, rank int")
class NearestRows:
    """Of a partition's rows (ref_id, neigh_id, distance, k), which come in order, the first k with their rank; no more than a counter is held."""

    def __init__(self):
        self.rank = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        self.rank += 1
        if self.rank <= row["k"]:
            yield row["ref_id"], row["neigh_id"], row["distance"], self.rank


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    for name, parameters, text in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {text}")
    for name, parameters, result, text in PLACES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {text}")
    spark.udtf.register("nearest_rows", NearestRows)
