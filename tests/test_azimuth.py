"""The azimuth query over whole tables."""

import duckdb
import numpy as np

from quakeframe import queries
from quakeframe.sources import lens

SF = "/root/testdata/sf0.01"


def test_azimuth_of_all_events_and_their_stations(spark):
    c = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    # haversine and bearing, written out here; km at the event's depth
    want = c.execute(
        lens.sql_for(f"""
        WITH p AS (SELECT e.id, s.id AS station_id, radians(e.latitude) AS a, radians(s.latitude) AS b, radians(s.longitude - e.longitude) AS l, e.depth FROM (SELECT DISTINCT event_id, station_id FROM ({lens.PHASE})) p JOIN ({lens.EVENT}) e ON e.id = p.event_id JOIN ({lens.STATION}) s ON s.id = p.station_id)
        SELECT id, station_id, degrees(atan2(sin(l) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(l))),
          2 * asin(sqrt(pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(l / 2), 2))) * (6371.00877141506 - depth)
        FROM p ORDER BY 1, 2""")
    ).fetchall()
    got = sorted(map(tuple, queries.queries()["azimuth"](spark, SF).select("id", "station_id", "azimuth", "km").collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert {r[0] for r in got if r[0] >= 200} and len({r[1] for r in got}) > 20
    g, w = (np.array([r[2:] for r in x], float) for x in (got, want))
    assert abs((g[:, 0] - w[:, 0] + 180) % 360 - 180).max() < 1e-4 and abs(g[:, 1] - w[:, 1]).max() < 1e-5
