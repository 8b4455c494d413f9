"""Schemas of catalogs and of what is derived from them.

Depths are km downwards, elevations m upwards, times microseconds since 1970 (``t_us``, BIGINT) or
TIMESTAMP in UTC, distances km, lags s. Missing values are NULL, never NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

STATION = "id string, latitude double, longitude double, elevation double, network string, station string, location string"
EVENT = "id bigint, t_us bigint, latitude double, longitude double, depth double, magnitude double, relocated boolean, start_rms double, final_rms double"
PHASE = (
    "event_id bigint, station_id string, t_us bigint, lower_unc double, upper_unc double, type string, network string, station string, location string,"
    " channel string, relocated boolean, weight double, start_residual double, final_residual double"
)
EDGE = "ref_id bigint, neigh_id bigint, type string, station_id string"
XCORR = "ev1 bigint, ev2 bigint, station_id string, type string, valid boolean, coefficient double, lag double"


@dataclass(frozen=True)
class Catalog:
    """Stations, events and phases."""

    stations: DataFrame
    events: DataFrame
    phases: DataFrame
