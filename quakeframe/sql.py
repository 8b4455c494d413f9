"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

import math

from .sources import lens

BASE = f"WITH RECURSIVE ev AS ({lens.EVENT}), st AS ({lens.STATION}), ph AS ({lens.PHASE}), ev2 AS ({lens.EVENT2}), o AS ({lens.ORIGIN})"
R = "6371.00877141506e0"
SQL: dict[str, str] = {}


def add(name: str, text: str) -> None:
    SQL[name] = lens.sql_for(text)


def angle(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(CASE WHEN abs({lat1} - {lat2}) < 1e-9 AND abs(radians({lon2} - {lon1})) < 1e-9 THEN 0e0 ELSE 2e0 * atan2(sqrt(greatest(0e0, least(1e0, {a}))), sqrt(1e0 - greatest(0e0, least(1e0, {a})))) END)"


def km(lat1: str, lon1: str, lat2: str, lon2: str, depth: str = "0e0") -> str:
    return f"({angle(lat1, lon1, lat2, lon2)} * ({R} - ({depth})))"


def km3(a: str, b: str, da: str | None = None, db: str | None = None) -> str:
    da, db = da or f"{a}.depth", db or f"{b}.depth"
    flat = km(f"{a}.latitude", f"{a}.longitude", f"{b}.latitude", f"{b}.longitude", f"({da} + {db}) / 2")
    return f"(CASE WHEN abs({da} - {db}) < 1e-7 THEN {flat} ELSE sqrt(pow({flat}, 2) + pow({da} - {db}, 2)) END)"


def az(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    y = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))"
    return f"(CASE WHEN abs({lat1} - {lat2}) < 1e-9 AND abs(radians({lon2} - {lon1})) < 1e-9 THEN 0e0 ELSE atan2({y}, {x}) END)"


def wrap(x: str, top: str = "360e0") -> str:
    return f"(({x}) - {top} * floor(({x}) / {top}))"


def wrap_lon(x: str) -> str:
    return f"({wrap(f'({x}) + 180e0')} - 180e0)"


WEIGHT = "CASE WHEN u < 0.3e0 AND u >= 0e0 AND u <= 0.05e0 THEN 1e0 WHEN u < 0.3e0 AND u >= 0.05e0 AND u <= 0.1e0 THEN 0.5e0 WHEN u < 0.3e0 AND u >= 0.1e0 AND u <= 0.2e0 THEN 0.25e0 WHEN u < 0.3e0 AND u >= 0.2e0 AND u <= 0.3e0 THEN 0.125e0 ELSE 0.0625e0 END"
PICKS = f"pk AS (SELECT *, CASE WHEN type IN ('P', 'Pg') THEN 'P' WHEN type = 'Sg' THEN 'S' ELSE 'NO' END AS grp, {WEIGHT} AS class_weight FROM (SELECT *, (lower_unc + upper_unc) / 2 AS u FROM ph))"
TIMED = f"""{PICKS}, ray AS (
  SELECT pk.*, e.t_us AS t0, e.depth + s.elevation / 1e3 AS up, CASE WHEN grp = 'P' THEN 5.8e0 ELSE 3.4e0 END AS v,
    {km("e.latitude", "e.longitude", "s.latitude", "s.longitude", "(e.depth - s.elevation / 1e3) / 2")} AS along, degrees({az("e.latitude", "e.longitude", "s.latitude", "s.longitude")}) AS azimuth
  FROM pk JOIN ev e ON e.id = pk.event_id JOIN st s ON s.id = pk.station_id
), timed AS (
  SELECT *, CAST(t_us - t0 AS DOUBLE) / 1e6 - travel_time AS residual, -cos(radians(90e0 - azimuth)) * dtdd / (pi() * {R} / 180e0) AS dx, -sin(radians(90e0 - azimuth)) * dtdd / (pi() * {R} / 180e0) AS dy, -dtdh AS dz
  FROM (SELECT *, sqrt(along * along + up * up) / v AS travel_time, degrees(atan2(up, along)) + 90e0 AS dip, cos(atan2(up, along)) / (v / (pi() * {R} / 180e0)) AS dtdd, sin(atan2(up, along)) / v AS dtdh FROM ray)
)"""


def pairs(limit: float) -> str:
    return f"pairs AS MATERIALIZED (SELECT * FROM (SELECT a.id AS ref_id, b.id AS neigh_id, {km3('a', 'b')} AS distance FROM ev a JOIN ev b ON a.id <> b.id AND abs(a.latitude - b.latitude) < {limit / 100}e0) WHERE distance <= {limit}e0)"


ELIGIBLE = f"""{pairs(5)}, sk AS (SELECT p.event_id, p.station_id, p.type, {km3("e", "s", "e.depth", "(-(s.elevation / 1e3))")} AS km FROM ph p JOIN ev e ON e.id = p.event_id JOIN st s ON s.id = p.station_id),
elig AS MATERIALIZED (SELECT * FROM (SELECT p.*, r.type, r.station_id, r.km, count(*) OVER (PARTITION BY p.ref_id, p.neigh_id) AS n FROM pairs p JOIN sk r ON r.event_id = p.ref_id JOIN sk b ON b.event_id = p.neigh_id AND b.station_id = r.station_id AND b.type = r.type) WHERE n >= 4),
peel0 AS MATERIALIZED (SELECT ref_id, neigh_id, any_value(distance) AS distance FROM elig GROUP BY 1, 2)"""
ROUNDS = 8
PEEL = ELIGIBLE + "".join(
    f", stay{k} AS MATERIALIZED (SELECT ref_id AS id FROM peel{k} GROUP BY 1 HAVING count(*) >= 4), peel{k + 1} AS MATERIALIZED (SELECT * FROM peel{k} WHERE ref_id IN (SELECT id FROM stay{k}) AND neigh_id IN (SELECT id FROM stay{k}))" for k in range(ROUNDS)
)
CHOSEN = f"{PEEL}, chosen AS MATERIALIZED (SELECT * FROM peel{ROUNDS} QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY distance, neigh_id) <= 10)"
ORIENTED = "oriented AS (SELECT * FROM chosen c WHERE ref_id < neigh_id OR NOT EXISTS (SELECT 1 FROM chosen d WHERE d.ref_id = c.neigh_id AND d.neigh_id = c.ref_id))"
DD = f"""{TIMED}, {CHOSEN}, {ORIENTED}, dd AS MATERIALIZED (
  SELECT g.ref_id, g.neigh_id, g.type, g.station_id, a.residual - b.residual AS residual, (a.class_weight + b.class_weight) / 2 AS weight
  FROM elig g JOIN oriented c ON c.ref_id = g.ref_id AND c.neigh_id = g.neigh_id
  JOIN timed a ON a.event_id = g.ref_id AND a.station_id = g.station_id AND a.type = g.type JOIN timed b ON b.event_id = g.neigh_id AND b.station_id = g.station_id AND b.type = g.type)"""
WEIGHTED = f"""{DD}, rd AS (SELECT * REPLACE (round(residual, 6) AS residual), ref_id % 8 AS part FROM dd), mid AS (SELECT part, median(residual) AS m FROM rd GROUP BY 1),
md AS (SELECT rd.part, median(abs(residual - m)) AS mad FROM rd JOIN mid ON mid.part = rd.part GROUP BY 1),
weighted AS MATERIALIZED (SELECT rd.*, mad, weight * CASE WHEN mad > 0 THEN pow(greatest(0e0, 1e0 - pow(residual * 0.67449e0 / (4e0 * mad), 2)), 2) WHEN residual = 0 THEN 1e0 ELSE 0e0 END AS final_weight FROM rd JOIN md ON md.part = rd.part)"""

CAT2 = "c2 AS (SELECT (id - 1000000) * 2 AS id, t_us, latitude, longitude, depth, magnitude FROM ev2), p2 AS (SELECT * REPLACE (event_id * 2 AS event_id) FROM ph WHERE event_id % 11 <> 0)"


def summed(events: str, phases: str) -> str:
    return f"SELECT e.id, e.t_us, round(e.depth, 6) AS depth, coalesce(n, 0) AS n_phases, CAST(coalesce(s, 0) AS BIGINT) AS sum_us FROM ({events}) e LEFT JOIN (SELECT event_id, count(*) AS n, sum(t_us) AS s FROM ({phases}) GROUP BY 1) p ON p.event_id = e.id"


add("catalog_load", f"{BASE} SELECT e.id, e.t_us, round(latitude, 6) AS latitude, round(depth, 6) AS depth, coalesce(n_phases, 0) AS n_phases, coalesce(n_stations, 0) AS n_stations FROM ev e LEFT JOIN (SELECT event_id, count(*) AS n_phases, count(DISTINCT station_id) AS n_stations FROM ph GROUP BY 1) p ON p.event_id = e.id")
add("catalog_merge_keepid", f"{BASE}, {CAT2}, f AS (SELECT * FROM c2 WHERE id NOT IN (SELECT id FROM ev)) " + summed("SELECT id, t_us, depth FROM ev UNION ALL SELECT id, t_us, depth FROM f", "SELECT event_id, t_us FROM ph UNION ALL SELECT event_id, t_us FROM p2 WHERE event_id IN (SELECT id FROM f)"))
add("catalog_merge_renumber", f"{BASE}, {CAT2}, f AS (SELECT *, (SELECT max(id) FROM ev) + row_number() OVER (ORDER BY id) AS nid FROM c2) " + summed("SELECT id, t_us, depth FROM ev UNION ALL SELECT nid, t_us, depth FROM f", "SELECT event_id, t_us FROM ph UNION ALL SELECT nid, p2.t_us FROM p2 JOIN f ON f.id = p2.event_id"))
add("upsert_event", f"{BASE}, {CAT2} SELECT e.id, coalesce(c2.t_us, e.t_us) AS t_us, round(coalesce(c2.depth, e.depth), 6) AS depth FROM ev e LEFT JOIN c2 ON c2.id = e.id")
add("remove_event_cascade", f"{BASE} " + summed("SELECT * FROM ev WHERE id % 3 <> 0", "SELECT * FROM ph WHERE event_id % 3 <> 0"))
add("extract_event", f"{BASE} SELECT station_id AS id, count(*) AS n FROM ph WHERE event_id % 3 = 0 GROUP BY 1")
add("orphan_phases", f"{BASE} SELECT 'event' AS missing, type, count(*) AS n FROM ph WHERE event_id % 7 = 0 GROUP BY 2 UNION ALL SELECT 'station', type, count(*) FROM ph JOIN st ON st.id = ph.station_id WHERE number % 5 = 0 GROUP BY 2")
add("remove_phase", f"{BASE} SELECT type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM ph WHERE NOT (event_id % 5 = 0 AND type = 'P') GROUP BY 1")
add("phase_class_weight", f'{BASE}, {PICKS} SELECT grp AS "group", class_weight, count(*) AS n, CAST(sum(t_us % 1000000) AS BIGINT) AS sum_us FROM pk GROUP BY 1, 2')
add("region_rect", f"{BASE} SELECT id, CAST(latitude BETWEEN 46.6e0 AND 46.9e0 AND CASE WHEN longitude < 8.2e0 THEN longitude - 8.2e0 + 360e0 ELSE longitude - 8.2e0 END <= 8.6e0 - 8.2e0 AS INT) AS plain, CAST(latitude BETWEEN 46.6e0 AND 46.9e0 AND CASE WHEN longitude < 8.5e0 THEN longitude - 8.5e0 + 360e0 ELSE longitude - 8.5e0 END <= 8.1e0 - 8.5e0 + 360e0 AS INT) AS wrapped FROM ev")
add("region_circle", f"{BASE} SELECT id FROM ev WHERE {km('latitude', 'longitude', '46.8e0', '8.4e0')} <= 12.5e0")
add("origin_filters", f"{BASE} SELECT author, mode, count(*) AS n, CAST(sum(seq) AS BIGINT) AS ids FROM o WHERE author IN ('click', 'view', 'error') AND agency NOT IN (3, 5) GROUP BY 1, 2")
add("iso_time", f"{BASE}, x AS (SELECT id, t_us + (id % 5) * 123456 AS t FROM ev), y AS (SELECT id, t, regexp_replace(strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S.%f'), '0+$', '') AS s FROM x) SELECT id, CASE WHEN s LIKE '%.' THEN s || '0000Z' ELSE s || 'Z' END AS iso, t AS back FROM y")
add("time_windows", f"{BASE}, w AS (SELECT id, t_us AS a, t_us + 60000000 AS b, t_us + (id % 9) * 10000000 AS c, t_us + (id % 9) * 10000000 + 20000000 AS d FROM ev) SELECT id, CASE WHEN greatest(a, c) < least(b, d) THEN greatest(a, c) END AS start, CASE WHEN greatest(a, c) < least(b, d) THEN least(b, d) END AS \"end\", greatest(b, d) - least(a, c) AS \"both\", CAST(a <= d AND d <= b AS INT) AS inside FROM w")
add("azimuth", f"{BASE} SELECT e.id, s.id AS station_id, round({wrap('degrees(' + az('e.latitude', 'e.longitude', 's.latitude', 's.longitude') + ')')}, 6) AS azimuth, round({km('e.latitude', 'e.longitude', 's.latitude', 's.longitude', 'e.depth')}, 6) AS km FROM (SELECT DISTINCT event_id, station_id FROM ph) p JOIN ev e ON e.id = p.event_id JOIN st s ON s.id = p.station_id")
add("direct_geodesic", f"{BASE}, x AS (SELECT id, latitude, longitude, CAST(id % 50 AS DOUBLE) / ({R} - depth) AS d, radians(CAST(id % 360 AS DOUBLE)) AS a, radians(latitude) AS f, id % 50 = 0 AS still FROM ev), y AS (SELECT *, asin(sin(f) * cos(d) + cos(f) * sin(d) * cos(a)) AS s FROM x) SELECT id, round(CASE WHEN still THEN latitude ELSE degrees(s) END, 6) AS lat, round(CASE WHEN still THEN longitude ELSE {wrap_lon('degrees(radians(longitude) + atan2(sin(a) * sin(d) * cos(f), cos(d) - sin(f) * sin(s)))')} END, 6) AS lon FROM y")
_V = ", ".join(f"CAST(id * {k + 11} % 101 AS DOUBLE) AS v{k}" for k in range(8))
_bi = lambda f, a, b, c, d: f"(({f}({a}) * (1 - y) + {f}({b}) * y) * (1 - x) + ({f}({c}) * (1 - y) + {f}({d}) * y) * x)"
_z = [f"(v{2 * m} * (1 - z) + v{2 * m + 1} * z)" for m in range(4)]
_deg = [f"radians(v{k} + 40)" for k in range(4)]
add("trilinear", f"{BASE}, g AS (SELECT id, CAST(id * 3 % 97 AS DOUBLE) / 97e0 AS x, CAST(id * 5 % 97 AS DOUBLE) / 97e0 AS y, CAST(id * 7 % 97 AS DOUBLE) / 97e0 AS z, {_V} FROM ev) SELECT id, round({_bi('', *_z)}, 6) AS value, round({_bi('', 'v0', 'v1', 'v2', 'v3')}, 6) AS flat, round({wrap('degrees(atan2(' + _bi('sin', *_deg) + ', ' + _bi('cos', *_deg) + '))')}, 4) AS degrees FROM g")
add("radius_pairs", f"{BASE}, {pairs(5)} SELECT ref_id, neigh_id, round(distance, 6) AS distance FROM pairs")
add("knn_events", f"{BASE}, d AS (SELECT a.id AS a_id, b.id AS b_id, {km3('a', 'b')} AS distance FROM ev a, ev b) SELECT a_id, b_id, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS rank, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) <= 5")
add("nearest_station", f"{BASE}, d AS (SELECT a.id AS a_id, b.number AS b_id, {km3('a', 'b', 'a.depth', '(-(b.elevation / 1e3))')} AS distance FROM ev a, st b) SELECT a_id, b_id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) = 1")
add("catalog_compare", f"{BASE}, m AS (SELECT a.id, b.id AS b_id, b.t_us - a.t_us AS time_us, {km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} * 1e3 AS epi, (b.depth - a.depth) * 1e3 AS dep, count(*) OVER (PARTITION BY a.id) AS n FROM ev a JOIN ev2 b ON abs(a.t_us - b.t_us) < 250000) SELECT e.id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, b_id, time_us, round(epi, 3) AS epi_m, round(dep, 3) AS depth_m, round(sqrt(epi * epi + dep * dep), 3) AS hypo_m FROM ev e LEFT JOIN m ON m.id = e.id")
XC = "xc AS (SELECT seq, seq * 7 % 50 AS ev1, seq * 13 % 50 + 50 * (seq % 2) AS ev2, 'S' || (seq % 4) AS station_id, CASE WHEN seq % 3 = 0 THEN 'S' ELSE 'P' END AS type, seq % 5 <> 0 AS valid, CAST(seq % 199 - 99 AS DOUBLE) / 99e0 AS coefficient, CAST(seq % 21 - 10 AS DOUBLE) / 100e0 AS lag FROM o WHERE seq * 7 % 50 <> seq * 13 % 50 + 50 * (seq % 2))"
add("xcorr_symmetric_lookup", f"{BASE}, {XC}, c AS (SELECT least(ev1, ev2) AS lo, greatest(ev1, ev2) AS hi, station_id, type, valid, coefficient, CASE WHEN ev1 > ev2 THEN -lag ELSE lag END AS lag FROM xc QUALIFY row_number() OVER (PARTITION BY least(ev1, ev2), greatest(ev1, ev2), station_id, type ORDER BY seq DESC) = 1), e AS (SELECT DISTINCT ev2 AS ref_id, ev1 AS neigh_id, station_id, type FROM xc) SELECT ref_id, neigh_id, e.station_id, e.type, CAST(valid AS INT) AS valid, round(coefficient, 6) + 0e0 AS coefficient, round(CASE WHEN ref_id > neigh_id THEN -lag ELSE lag END, 6) + 0e0 AS lag FROM e JOIN c ON c.lo = least(ref_id, neigh_id) AND c.hi = greatest(ref_id, neigh_id) AND c.station_id = e.station_id AND c.type = e.type")
add("sensor_validity_join", f"{BASE}, s AS (SELECT id, k, 1577836800000000 + k * 30000000000 AS a, CASE WHEN k < 3 THEN 1577836800000000 + (k + 1) * 30000000000 + 1000 END AS b FROM st, (SELECT unnest([0, 1, 3]) AS k)), m AS (SELECT p.*, (SELECT arg_max(k, a) FROM s WHERE s.id = p.station_id AND p.t_us >= a AND (b IS NULL OR p.t_us < b)) AS epoch FROM ph p) SELECT station_id, epoch, count(*) AS n, max(t_us) AS last_us FROM m GROUP BY 1, 2")
add("request_coalesce", f"{BASE}, q AS (SELECT station_id, t_us - 20000000 AS a, t_us + 25000000 AS b, count(*) AS c FROM ph GROUP BY 1, 2, 3), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY station_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2000000 THEN 0 ELSE 1 END AS fresh FROM q), g AS (SELECT *, sum(fresh) OVER (PARTITION BY station_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT station_id, min(a) AS start_us, max(b) AS end_us, CAST(sum(c) AS BIGINT) AS n FROM g GROUP BY station_id, k")
add("containing_trace", f"{BASE}, t AS (SELECT station_id, t_us - 60000000 AS a, t_us + 90000000 AS b, event_id AS k FROM ph), q AS (SELECT DISTINCT station_id, t_us - 10000000 AS x, t_us + 10000000 AS y FROM ph), m AS (SELECT q.station_id, k FROM q JOIN t ON t.station_id = q.station_id AND a <= x AND b >= y QUALIFY row_number() OVER (PARTITION BY q.station_id, x, y ORDER BY a, k) = 1) SELECT station_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids FROM m GROUP BY 1")
add("common_phases", f"{BASE}, {ELIGIBLE} SELECT ref_id, neigh_id, count(*) AS n, round(sum(km), 6) AS km FROM elig GROUP BY 1, 2")
add("neigh_peel", f"{BASE}, {PEEL} SELECT ref_id, count(*) AS n FROM peel{ROUNDS} GROUP BY 1")
add("neigh_nearest", f"{BASE}, {CHOSEN} SELECT c.ref_id, c.neigh_id, count(*) AS n, round(any_value(c.distance), 6) AS distance FROM chosen c JOIN elig e ON e.ref_id = c.ref_id AND e.neigh_id = c.neigh_id GROUP BY 1, 2")
_SIZES = [5.0 / 2 ** (2 - k) for k in range(3)]
_SHELL = " ".join(f"WHEN pow(h / {s}e0, 2) + pow(dz / {2 * s}e0, 2) <= 1 THEN {k}" for k, s in enumerate(_SIZES))
_QUAD = "CASE WHEN n AND e THEN 1 WHEN NOT n AND e THEN 2 WHEN NOT n THEN 3 ELSE 4 END"
add("neigh_ellipsoid", f"""{BASE}, {pairs(10)}, g AS (SELECT p.*, {km("a.latitude", "a.longitude", "b.latitude", "b.longitude", "a.depth")} AS h, b.depth - a.depth AS dz, b.latitude >= a.latitude AS n, b.longitude >= a.longitude AS e FROM pairs p JOIN ev a ON a.id = p.ref_id JOIN ev b ON b.id = p.neigh_id),
s AS (SELECT *, CASE {_SHELL} END AS shell, {_QUAD} + CASE WHEN dz >= 0 THEN 0 ELSE 4 END AS octant FROM g), t AS (SELECT *, row_number() OVER (PARTITION BY ref_id, shell, octant ORDER BY distance, neigh_id) AS turn FROM s WHERE shell IS NOT NULL)
SELECT ref_id, neigh_id, CAST(shell AS BIGINT) AS shell, CAST(octant AS BIGINT) AS octant FROM t QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY turn, shell, octant) <= 8""")
_IN = "pow({} / 5e0, 2) + pow((b.depth - a.depth) / 10e0, 2) <= 1".format(km("a.latitude", "a.longitude", "b.latitude", "b.longitude", "a.depth"))
_WIDE = PEEL.replace(pairs(5), pairs(10).replace("a.id <> b.id", f"a.id <> b.id AND {_IN}"))
add("neigh_shells", f"""{BASE}, {_WIDE}, g AS (SELECT p.*, {km("a.latitude", "a.longitude", "b.latitude", "b.longitude", "a.depth")} AS h, b.depth - a.depth AS dz, b.latitude >= a.latitude AS n, b.longitude >= a.longitude AS e FROM peel{ROUNDS} p JOIN ev a ON a.id = p.ref_id JOIN ev b ON b.id = p.neigh_id),
s AS (SELECT *, CASE {_SHELL} END AS shell, {_QUAD} + CASE WHEN dz >= 0 THEN 0 ELSE 4 END AS octant FROM g), t AS (SELECT *, row_number() OVER (PARTITION BY ref_id, shell, octant ORDER BY distance, neigh_id) AS turn FROM s WHERE shell IS NOT NULL),
c AS (SELECT ref_id, neigh_id FROM t QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY turn, shell, octant) <= 8)
SELECT e.ref_id, e.neigh_id, count(*) AS n FROM elig e JOIN c ON c.ref_id = e.ref_id AND c.neigh_id = e.neigh_id GROUP BY 1, 2""")
add("clusters", f"{BASE}, {CHOSEN}, link AS MATERIALIZED (SELECT ref_id AS a, neigh_id AS b FROM chosen UNION SELECT neigh_id, ref_id FROM chosen), reach AS (SELECT a AS id, a AS c FROM link UNION SELECT l.b, r.c FROM reach r JOIN link l ON l.a = r.id) SELECT id, min(c) AS cluster_id FROM reach GROUP BY 1")
add("pair_orientation", f"{BASE}, {pairs(5)}, chosen AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY distance, neigh_id) <= 6), {ORIENTED} SELECT ref_id, neigh_id FROM oriented")
add("event_rms", f"{BASE}, {TIMED} SELECT event_id, count(*) AS n, round(sqrt(sum(pow(residual * class_weight, 2)) / sum(pow(class_weight, 2))), 6) AS rms FROM timed GROUP BY 1")
_FIVE = "min(v) AS min, list_sort(list(v))[n // 4 + 1] AS q1, list_sort(list(v))[n // 2 + 1] AS q2, list_sort(list(v))[n // 4 + n // 2 + 1] AS q3, max(v) AS max"
add("five_number", f"{BASE}, x AS (SELECT station_id, type, lower_unc AS v, count(*) OVER (PARTITION BY station_id, type) AS n FROM ph) SELECT station_id, type, n, {_FIVE} FROM x GROUP BY station_id, type, n")
add("median_mad", f"{BASE}, x AS (SELECT station_id, depth FROM ph JOIN ev ON ev.id = ph.event_id), m AS (SELECT station_id, count(*) AS n, median(depth) AS md, avg(depth) AS mn FROM x GROUP BY 1) SELECT m.station_id, any_value(n) AS n, round(any_value(md), 6) AS median, round(median(abs(depth - md)), 6) AS mad, round(any_value(mn), 6) AS mean, round(avg(abs(depth - mn)), 6) AS mean_deviation FROM m JOIN x ON x.station_id = m.station_id GROUP BY 1")
add("circular_mean", f"{BASE} SELECT station_id, round(degrees(atan2(sum(sin(radians(event_id % 360))), sum(cos(radians(event_id % 360))))), 6) AS direction FROM ph GROUP BY 1")
add("dist_binned_residuals", f'{BASE}, {pairs(5)}, x AS (SELECT round(distance, 6) AS distance, (ref_id * 31 + neigh_id * 17) % 1009 AS v, row_number() OVER (ORDER BY round(distance, 6), ref_id, neigh_id) AS k, count(*) OVER () AS total FROM pairs), b AS (SELECT *, (k - 1) // (total // 20 + 1) AS bin FROM x), c AS (SELECT *, count(*) OVER (PARTITION BY bin) AS n FROM b) SELECT bin, n, {_FIVE}, min(distance) AS "from", max(distance) AS "to" FROM c GROUP BY bin, n')
add("xcorr_summary", f"{BASE}, {XC} SELECT type, station_id, count(*) AS attempted, count(*) FILTER (WHERE NOT valid) AS failed, count(*) FILTER (WHERE valid AND abs(coefficient) >= 0.6e0) AS good, round(avg(abs(coefficient)) FILTER (WHERE valid), 6) AS mean_coefficient, round(100e0 * count(*) FILTER (WHERE NOT valid) / count(*), 6) AS failed_percent, round(100e0 * count(*) FILTER (WHERE valid AND abs(coefficient) >= 0.6e0) / count(*), 6) AS good_percent FROM xc GROUP BY ROLLUP (type, station_id)")
add("origin_quality", f"{BASE}, {TIMED}, u AS (SELECT *, class_weight >= 0.25e0 AS used, travel_time * 5.8e0 AS d FROM timed) SELECT event_id, count(*) AS phases, count(*) FILTER (WHERE used) AS used_phases, count(DISTINCT station_id) AS stations, count(DISTINCT station_id) FILTER (WHERE used) AS used_stations, round(median(d) FILTER (WHERE used), 6) AS median_distance, round(min(d) FILTER (WHERE used), 6) AS min_distance, round(max(d) FILTER (WHERE used), 6) AS max_distance, round(sqrt(avg(residual * residual) FILTER (WHERE used)), 6) AS standard_error FROM u GROUP BY 1")
add("azimuthal_gap", f"{BASE}, {TIMED}, a AS (SELECT DISTINCT event_id, round({wrap('azimuth')}, 6) AS z FROM timed), t AS (SELECT * FROM a UNION ALL SELECT event_id, z + 360e0 FROM a), g AS (SELECT event_id, z, lead(z, 1) OVER w - z AS g1, lead(z, 2) OVER w - z AS g2 FROM t WINDOW w AS (PARTITION BY event_id ORDER BY z)) SELECT event_id, round(CASE WHEN count(*) < 2 THEN 360e0 ELSE max(g1) END, 6) AS gap, round(CASE WHEN count(*) < 2 THEN 360e0 ELSE least(360e0, max(g2)) END, 6) AS secondary_gap FROM g WHERE z < 360 GROUP BY 1")
add("rms_quantiles", f"{BASE}, {TIMED}, r AS (SELECT round(sqrt(sum(pow(residual * class_weight, 2)) / sum(pow(class_weight, 2))), 6) AS rms FROM timed GROUP BY event_id), q AS (SELECT quantile_cont(rms, [{', '.join(f'{i / 20}' for i in range(21))}]) AS q FROM r) SELECT CAST(k AS BIGINT) AS k, round(q[k + 1], 9) AS rms FROM q, (SELECT unnest(range(21)) AS k)")
add("equal_frequency", f"{BASE}, q AS (SELECT list_distinct(quantile_cont(depth, [{', '.join(f'{i / 10}' for i in range(1, 10))}])) AS c FROM ev), b AS (SELECT depth, len(list_filter(c, lambda x: x < depth)) AS bin FROM ev, q) SELECT bin, count(*) AS n, round(min(depth), 6) AS low, round(max(depth), 6) AS high FROM b GROUP BY 1")
_RULES = {"last": "created_s DESC", "first": "created_s", "max-phases": "n_phases DESC", "min-phases": "n_phases", "max-rms": "rms_milli DESC", "min-rms": "rms_milli"}
add("best_origin", BASE + " " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{r}' AS rule, event_id, seq FROM o QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY {k}, seq DESC) = 1)" for r, k in _RULES.items()))
add("map_centroid", f"{BASE}, b AS (SELECT latitude, longitude FROM ev UNION ALL SELECT latitude, longitude FROM ev2) SELECT round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, count(*) AS n FROM b")
add("tt_homogeneous", f"{BASE}, {TIMED} SELECT event_id, station_id, type, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("travel_time", "azimuth", "dip", "dtdd", "dtdh", "residual")) + " FROM timed")
add("partials", f"{BASE}, {TIMED} SELECT event_id, station_id, type, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz FROM timed")
add("first_arrival", f"{BASE}, {TIMED} SELECT event_id, station_id, type AS phase, round(travel_time, 6) AS travel_time FROM timed QUALIFY row_number() OVER (PARTITION BY event_id, station_id ORDER BY round(travel_time, 6), type) = 1")
_TT = lambda i, k: f"sqrt(pow(({i}) * 5e0, 2) + pow(({k}) * 3e0, 2)) / CASE WHEN grp = 'P' THEN 5.8e0 ELSE 3.4e0 END"
add("tt_table", f"{BASE}, {PICKS}, x AS (SELECT pk.event_id, station_id, type, grp, e.depth, (pk.event_id * 37 + pk.lower_unc * 1000) % 1050 / 10e0 AS km FROM pk JOIN ev e ON e.id = pk.event_id), y AS (SELECT *, least(floor(km / 5e0), 19) AS i, least(floor(depth / 3e0), 5) AS k FROM x), z AS (SELECT *, km / 5e0 - i AS f, depth / 3e0 - k AS g FROM y) SELECT event_id, station_id, type, CASE WHEN km <= 100e0 AND depth <= 18e0 THEN round((1 - f) * (1 - g) * {_TT('i', 'k')} + (1 - f) * g * {_TT('i', 'k + 1')} + f * (1 - g) * {_TT('i + 1', 'k')} + f * g * {_TT('i + 1', 'k + 1')}, 6) END AS travel_time FROM z")
TRACES = "tr AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS s FROM embeddings), pr AS (SELECT a.id, a.s AS a, b.s AS b FROM tr a JOIN tr b ON b.id = a.id + 1)"
add("xcorr_windows", f"{BASE}, {TIMED}, x AS (SELECT *, 1e0 + round(travel_time, 3) * 0.05e0 / 1.25e0 AS g FROM timed), y AS (SELECT *, t_us + CAST(round((-0.5e0 * g - 0e0) * 1e6) AS BIGINT) AS a, t_us + CAST(round((-0.5e0 * g - 0.5e0) * 1e6) AS BIGINT) AS c FROM x) SELECT event_id, station_id, type, a AS start_us, a + CAST(round((1.25e0 * g + 0e0) * 1e6) AS BIGINT) AS end_us, c AS long_start_us, c + CAST(round((1.25e0 * g + 1e0) * 1e6) AS BIGINT) AS long_end_us FROM y")
_dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
add("trace_pearson", f"WITH {TRACES}, m AS (SELECT id, len(a) AS n, list_sum(a) AS sa, list_sum(b) AS sb, {_dot('a', 'b')} AS ab, {_dot('a', 'a')} AS aa, {_dot('b', 'b')} AS bb FROM pr) SELECT id, round((n * ab - sa * sb) / (sqrt(n * aa - sa * sa) * sqrt(n * bb - sb * sb)), 6) AS coefficient FROM m")
add("l2_transform", f"WITH {TRACES}, m AS (SELECT id, list_transform(list_zip(a, b), lambda p: sqrt(p[1] * p[1] + p[2] * p[2])) AS n FROM pr) SELECT id, round(list_max(n), 6) AS top, round(list_sum(n), 6) AS total FROM m")
add("rt_transform", f"WITH {TRACES}, c AS (SELECT *, cos(radians(id % 360)) AS c, sin(radians(id % 360)) AS s FROM pr), m AS (SELECT id, list_transform(list_zip(a, b), lambda p: -p[1] * c - p[2] * s) AS r, list_transform(list_zip(a, b), lambda p: p[1] * s - p[2] * c) AS t FROM c) SELECT id, round(r[1], 6) AS r0, round(t[1], 6) AS t0, round(list_max(r), 6) AS r, round(list_max(t), 6) AS t FROM m")
add("demean_slice", f"WITH {TRACES}, m AS (SELECT id, s, list_avg(s) AS mean, id % 7 * 5 AS lo, CAST(ceil((id % 7 * 50000 + 205000) * 100e0 / 1e6) AS BIGINT) AS hi FROM tr) SELECT id, hi - lo + 1 AS n, round(s[lo + 1] - mean, 6) AS first, round(s[hi + 1] - mean, 6) AS last FROM m")
add("double_differences", f"{BASE}, {DD} SELECT ref_id, neigh_id, type, station_id, round(residual, 6) AS residual, round(weight, 6) AS weight FROM dd")
add("residual_weights", f"{BASE}, {WEIGHTED} SELECT part, count(*) AS n, round(max(mad), 6) AS mad, round(sum(final_weight), 3) AS weight FROM weighted GROUP BY 1")
_ENDS = "ends AS (SELECT ref_id AS event_id, type, station_id, final_weight FROM weighted UNION ALL SELECT neigh_id, type, station_id, final_weight FROM weighted)"
add("tt_constraint_rows", f"{BASE}, {WEIGHTED}, {_ENDS}, m AS (SELECT event_id, type, station_id, count(*) AS n, avg(final_weight) * 0.3e0 AS w FROM ends WHERE final_weight > 0 GROUP BY 1, 2, 3) SELECT m.event_id, m.type, m.station_id, n, round(w, 5) AS weight, round(residual, 6) AS residual FROM m JOIN timed t ON t.event_id = m.event_id AND t.type = m.type AND t.station_id = m.station_id")
add("column_norms", f"{BASE}, {WEIGHTED}, {_ENDS}, x AS (SELECT e.event_id, final_weight AS w, dx, dy, dz FROM ends e JOIN timed t ON t.event_id = e.event_id AND t.type = e.type AND t.station_id = e.station_id), a AS (SELECT event_id, unnest(['x', 'y', 'z', 't']) AS axis, unnest([dx * w, dy * w, dz * w, w]) AS v FROM x) SELECT event_id, axis, count(*) FILTER (WHERE v <> 0) AS n, round(sqrt(sum(v * v)), 4) AS norm FROM a GROUP BY 1, 2")
add("debounce_latest", f"{BASE}, u AS (SELECT 'o' || event_id AS public_id, 1577836800 + created_s AS t, max(seq) AS seq FROM o GROUP BY 1, 2), m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY public_id ORDER BY t) <= 600 THEN 0 ELSE 1 END AS fresh FROM u), g AS (SELECT *, sum(fresh) OVER (PARTITION BY public_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT public_id, max(t) AS time_s, arg_max(seq, t) AS seq, count(*) AS updates, max(t) + 600 AS due_s FROM g GROUP BY public_id, k")
_LON = lambda a: f"CASE WHEN longitude < {a}e0 THEN longitude - {a}e0 + 360e0 ELSE longitude - {a}e0 END"
add("profile_routing", f"{BASE}, r AS (SELECT seq, CASE WHEN latitude BETWEEN 47e0 AND 48e0 AND {_LON(7)} <= 2.5e0 THEN 'north' WHEN {km('latitude', 'longitude', '46.8e0', '8.4e0')} <= 30e0 THEN 'centre' WHEN latitude < 46.8e0 THEN 'rest' END AS profile FROM o) SELECT profile, count(*) AS n, CAST(sum(seq) AS BIGINT) AS ids FROM r WHERE profile IS NOT NULL GROUP BY 1")
add("tumbling", f"{BASE} SELECT author, 1577836800 + created_s // 3600 * 3600 AS start_s, count(*) AS n FROM o GROUP BY 1, 2")
add("sliding", f"{BASE} SELECT author, 1577836800 + (created_s // 1200 - k) * 1200 AS start_s, count(*) AS n FROM o, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2")

add("origin_list", f"{BASE}, i AS (SELECT DISTINCT unnest([seq, seq + 1000000000]) AS k FROM o), j AS (SELECT * FROM i WHERE k % 3 = 0) SELECT CASE WHEN seq IS NULL THEN 'missing' ELSE 'found' END AS kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids FROM j LEFT JOIN o ON o.seq = j.k GROUP BY 1")
add("parent_event", f"{BASE}, r AS (SELECT seq - seq % 2 AS k, arg_min(event_id, seq) AS event_id FROM o GROUP BY 1) SELECT o.seq AS public_id, r.event_id, round(e.magnitude, 6) AS preferred_magnitude FROM o LEFT JOIN r ON r.k = o.seq LEFT JOIN ev e ON e.id = r.event_id")
add("event_list", f"{BASE}, e AS (SELECT id, CASE WHEN id % 5 > 0 THEN 'type' || (id % 5) END AS type FROM ev), r AS (SELECT *, CASE WHEN seq % 4 > 0 THEN 'St' || (seq % 4) END AS status FROM o) SELECT type, status, count(*) AS n, CAST(sum(seq) AS BIGINT) AS ids FROM r JOIN e ON e.id = r.event_id WHERE (status IS NULL OR status <> 'St2') AND author IN ('click', 'view') AND created_s >= 10000 AND created_s < 80000 AND n_phases >= 4 AND seq > 100 AND (type IS NULL OR type IN ('type2', 'type3')) GROUP BY 1, 2")
add("phase_type_map", f"{BASE} SELECT CASE WHEN event_id % 4 = 0 THEN type WHEN type = 'P' THEN 'Pn' WHEN type = 'S' THEN 'Sn' ELSE type END AS type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM ph GROUP BY 1")
add("channel_codes", f"{BASE}, c AS (SELECT DISTINCT substring('HHZ1', 1, event_id % 5) AS channel FROM ph) SELECT channel, CASE WHEN length(channel) >= 2 THEN substring(channel, 1, 2) ELSE '' END AS band, CASE WHEN length(channel) = 3 THEN substring(channel, 3, 1) ELSE '' END AS component FROM c")
add("pick_uncertainty", f"{BASE}, u AS (SELECT type, CASE WHEN event_id % 5 = 0 THEN 0.25e0 WHEN event_id % 3 > 0 AND event_id % 4 > 0 THEN lower_unc END AS lo, CASE WHEN event_id % 5 = 0 THEN 0.25e0 WHEN event_id % 3 > 0 AND event_id % 4 > 0 THEN upper_unc END AS up FROM ph) SELECT type, count(lo) AS n, round(sum(lo), 6) AS lower, round(sum(up), 6) AS upper FROM u GROUP BY 1")
add("same_event", f"{BASE}, b AS (SELECT id, t_us + 300000 - (id - 1000000) % 7 * 100000 AS t_us, latitude, longitude, depth - 0.5e0 AS depth, magnitude FROM ev2) SELECT ev.id, b.id AS wanted_id FROM ev JOIN b ON ev.t_us = b.t_us AND ev.latitude = b.latitude AND ev.longitude = b.longitude AND ev.depth = b.depth AND ev.magnitude IS NOT DISTINCT FROM b.magnitude")
add("origin_dedup", f"{BASE}, d AS (SELECT event_id, created_s, min(seq) AS seq FROM o GROUP BY 1, 2) SELECT event_id, count(*) AS n, CAST(sum(seq) AS BIGINT) AS ids FROM d GROUP BY 1")
add("map_view", f"{BASE} SELECT 'inside' AS view, id FROM ev WHERE t_us >= 1577836800000000 + 1220000000 AND latitude BETWEEN 46.6e0 AND 47e0 AND longitude BETWEEN 8.1e0 AND 8.6e0 UNION ALL SELECT 'around', id FROM ev WHERE t_us <= 1577836800000000 + 54900000000 AND (longitude >= 8.5e0 OR longitude <= 8.2e0)")
add("map_links", f"{BASE} SELECT a.id, " + ", ".join(f"round({t}.{c}, 6) AS {c}{k}" for k, t in ((1, "a"), (2, "b")) for c in ("latitude", "longitude", "depth")) + " FROM ev a JOIN ev2 b ON b.id - 1000000 = a.id")
add("grid_nearest", f"{BASE}, d AS (SELECT s.number AS station_id, g.id AS grid_id, {km('s.latitude', 's.longitude', 'g.latitude', 'g.longitude')} AS distance FROM st s JOIN ev g ON abs(s.latitude - g.latitude) < 0.04e0) SELECT station_id, grid_id, round(distance, 6) AS distance FROM d WHERE distance <= 4e0 QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY distance, grid_id) = 1")
add("waveform_counters", f"{BASE}, a AS (SELECT station_id, t_us - t_us % 60000000 AS s, count(*) AS n FROM ph GROUP BY 1, 2) SELECT station_id, count(*) FILTER (WHERE s % 7 <> 0) AS found, count(*) FILTER (WHERE s % 7 = 0) AS unavailable, CAST(coalesce(sum(n - 1) FILTER (WHERE s % 7 <> 0), 0) AS BIGINT) AS cached FROM a GROUP BY 1")
add("common_stations", f"{BASE}, p AS (SELECT DISTINCT station_id, event_id % 50 AS part FROM ph WHERE type IN ('P', 'Pg')), s AS (SELECT DISTINCT station_id, event_id % 50 AS part FROM ph WHERE type = 'Sg') SELECT CASE WHEN s.part IS NULL THEN 'P' ELSE 'both' END AS kind, p.part, count(*) AS n FROM p LEFT JOIN s ON s.station_id = p.station_id AND s.part = p.part GROUP BY 1, 2")
add("limited_phases", f"""{BASE}, {pairs(5)}, sk AS (SELECT p.event_id, p.station_id, p.type, {km3("e", "s", "e.depth", "(-(s.elevation / 1e3))")} AS km FROM ph p JOIN ev e ON e.id = p.event_id JOIN st s ON s.id = p.station_id WHERE true),
m AS (SELECT p.*, r.type, r.station_id, r.km FROM pairs p JOIN sk r ON r.event_id = p.ref_id JOIN sk b ON b.event_id = p.neigh_id AND b.station_id = r.station_id AND b.type = r.type WHERE r.km BETWEEN 8e0 AND 60e0 AND b.km BETWEEN 8e0 AND 60e0 AND r.km >= p.distance * 3e0 AND b.km >= p.distance * 3e0),
k AS (SELECT *, count(*) OVER (PARTITION BY ref_id, neigh_id) AS n, row_number() OVER (PARTITION BY ref_id, neigh_id ORDER BY km, station_id, type) AS k FROM m)
SELECT ref_id, neigh_id, count(*) AS n, round(sum(km), 6) AS km FROM k WHERE n >= 2 AND k <= 6 GROUP BY 1, 2""")
add("neighbour_catalog", f"{BASE}, {pairs(5)}, c AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY distance, neigh_id) <= 3) SELECT event_id, count(*) AS n FROM ph WHERE event_id IN (SELECT neigh_id FROM c) GROUP BY 1")
add("edge_order", f"{BASE}, {ELIGIBLE}, p AS (SELECT ref_id, row_number() OVER (PARTITION BY ref_id ORDER BY station_id, type, neigh_id) AS place, ntile(4) OVER (PARTITION BY ref_id ORDER BY round(distance, 6), neigh_id, station_id, type) - 1 AS chunk FROM elig) SELECT ref_id, chunk, count(*) AS n, CAST(sum(place) AS BIGINT) AS places FROM p GROUP BY 1, 2")
add("lagged_differences", f"""{BASE}, {DD}, h AS (SELECT *, ref_id * 7 + neigh_id * 13 AS h FROM dd), u AS (SELECT *, CAST(h % 199 - 99 AS DOUBLE) / 99e0 AS cc, CAST(h % 21 - 10 AS DOUBLE) / 100e0 AS lag FROM h), v AS (SELECT *, h % 5 > 0 AND abs(cc) >= 0.5e0 AS used FROM u)
SELECT ref_id, neigh_id, type, station_id, round(CASE WHEN used THEN residual - lag ELSE residual END, 6) AS residual, round(CASE WHEN used THEN weight + weight * abs(cc) ELSE weight END, 6) AS weight, CAST(used AS INT) AS used FROM v""")
add("session", f"{BASE}, u AS (SELECT author, 1577836800 + created_s AS t, lag(1577836800 + created_s) OVER (PARTITION BY author ORDER BY created_s, seq) AS before, row_number() OVER (PARTITION BY author ORDER BY created_s, seq) AS i FROM o), m AS (SELECT *, CASE WHEN t - before <= 300 THEN 0 ELSE 1 END AS fresh FROM u), g AS (SELECT *, sum(fresh) OVER (PARTITION BY author ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT author, min(t) AS start_s, max(t) + 300 AS end_s, count(*) AS n FROM g GROUP BY author, k")
# grids: the values at a cell's corners straight from the formula that the grids' nodes are made by
_C, _S = "cos(radians(20e0))", "sin(radians(20e0))"


def _flat(lat: str, lon: str) -> tuple[str, str]:
    x, y = f"(({wrap(f'{lon} - 8.4e0 + 180e0')} - 180e0) * {math.pi * 6371.0 / 180.0!r}e0 * cos(radians({lat})))", f"(({lat} - 46.8e0) * {math.pi * 6371.0 / 180.0!r}e0)"
    return f"({x} * {_C} + {y} * {_S})", f"({y} * {_C} - {x} * {_S})"


_EX, _EY = _flat("e.latitude", "e.longitude")
_SX, _SY = _flat("s.latitude", "s.longitude")
add("tt_grid", f"""{BASE}, p AS (
  SELECT f.event_id, f.station_id, f.type, CASE WHEN f.type = 'Sg' THEN 'S' ELSE 'P' END AS g, s.number % 7 = 0 AS bare, {_EX} AS x, {_EY} AS y, {_SX} AS sx, {_SY} AS sy, e.depth AS z, -s.elevation / 1e3 AS sz, {az("e.latitude", "e.longitude", "s.latitude", "s.longitude")} AS az
  FROM ph f JOIN ev e ON e.id = f.event_id JOIN st s ON s.id = f.station_id),
q AS (SELECT *, (x + 45e0) / 30e0 AS ox, CASE WHEN g = 'P' THEN (y + 45e0) / 15e0 ELSE sqrt(pow(x - sx, 2) + pow(y - sy, 2)) / 15e0 END AS oy, z / 5e0 AS oz FROM p),
i AS (SELECT *, CASE WHEN bare THEN 'no_grid' WHEN oz BETWEEN 0 AND 3 AND oy BETWEEN 0 AND 6 AND (g = 'S' OR ox BETWEEN 0 AND 3) THEN 'ok' ELSE 'out_of_grid' END AS found,
  least(floor(ox), 2) AS ix, least(floor(oy), 5) AS iy, least(floor(oz), 2) AS iz FROM q),
c AS (SELECT *, (CASE WHEN g = 'S' THEN CASE WHEN a = 0 THEN 1e0 ELSE 0e0 END WHEN a = 0 THEN 1 - (ox - ix) ELSE ox - ix END) * (CASE WHEN b = 0 THEN 1 - (oy - iy) ELSE oy - iy END) * (CASE WHEN d = 0 THEN 1 - (oz - iz) ELSE oz - iz END) AS w,
  -45e0 + (ix + a) * 30e0 AS px, CASE WHEN g = 'P' THEN -45e0 ELSE 0e0 END + (iy + b) * 15e0 AS py, (iz + d) * 5e0 AS pz
  FROM i, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS d)),
n AS (SELECT *, CASE WHEN g = 'P' THEN sqrt(pow(sx - px, 2) + pow(sy - py, 2)) ELSE py END AS along, pz - sz AS up, CASE WHEN g = 'P' THEN 5.8e0 ELSE 3.4e0 END AS v FROM c),
m AS (SELECT event_id, station_id, type, found, any_value(g) AS g, any_value(az) AS az, sum(w * sqrt(along * along + up * up) / v) AS tt, sum(w * (90e0 + degrees(atan2(up, along)))) AS dip,
  sum(w * sin(atan2(sx - px, sy - py) - radians(20e0))) AS n1, sum(w * cos(atan2(sx - px, sy - py) - radians(20e0))) AS n2, any_value(v + z / 100e0) AS vel FROM n GROUP BY 1, 2, 3, 4),
r AS (SELECT *, {wrap("CASE WHEN g = 'P' THEN degrees(atan2(n1, n2)) ELSE degrees(az) END")} AS azimuth FROM m)
SELECT event_id, station_id, type, found, CASE WHEN found = 'ok' THEN round(tt, 6) END AS travel_time, CASE WHEN found = 'ok' THEN round(azimuth, 6) END AS azimuth, CASE WHEN found = 'ok' THEN round(dip, 6) END AS dip,
  CASE WHEN found = 'ok' THEN round(cos(radians(dip - 90e0)) / (vel / ({R} * pi() / 180e0)), 6) END AS dtdd, CASE WHEN found = 'ok' THEN round(sin(radians(dip - 90e0)) / vel, 6) END AS dtdh FROM r""")
# sliding coefficients: the short trace is samples 17 to 48 of 64, and meets the longer one at shifts of -10 to 10 samples from the middle
add("cross_correlate", f"""WITH {TRACES}, c AS (SELECT id, list_slice(a, 17, 48) AS x, b, len(b) AS n FROM pr), l AS (SELECT *, (n - 32) // 2 AS room, least(10, (n - 32) // 2) AS delay FROM c),
w AS (SELECT id, k, delay, x, list_slice(b, room - delay + k + 1, room - delay + k + 32) AS y FROM l, (SELECT unnest(range(21)) AS k) WHERE k <= 2 * delay),
m AS (SELECT id, k, delay, list_transform(x, lambda v: v - list_avg(x)) AS x, list_transform(y, lambda v: v - list_avg(y)) AS y FROM w),
r AS (SELECT id, k, delay, {_dot('x', 'y')} / sqrt({_dot('x', 'x')} * {_dot('y', 'y')}) AS cc FROM m)
SELECT id, 1 AS valid, round(cc, 6) AS coefficient, round(CAST(k - delay AS DOUBLE) / 100e0, 6) + 0e0 AS lag FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(cc) DESC, k) = 1""")
# sinc low pass under a Hann window, as sums over the samples near each new one
_HALF = int(-(-5.98 * 100.0 // 3.0)) // 2
add("resample", f"""WITH {TRACES}, g AS (SELECT id, s, len(s) AS n, unnest(range(CAST(floor(len(s) * 60e0 / 100e0) AS BIGINT))) AS j FROM tr),
t AS (SELECT id, j, s, n, j * 100e0 / 60e0 AS x, CAST(floor(j * 100e0 / 60e0) AS BIGINT) + unnest(range(-{_HALF}, {_HALF})) AS k FROM g),
v AS (SELECT id, j, sum(CASE WHEN k >= 0 AND k < n THEN s[k + 1] * 0.6e0 * pow(sin(pi() * (0.5e0 + (k - x) / {2 * _HALF}e0)), 2) * CASE WHEN k = x THEN 1e0 ELSE sin(pi() * 0.6e0 * (k - x)) / (pi() * 0.6e0 * (k - x)) END ELSE 0e0 END) AS y FROM t GROUP BY id, j)
SELECT id, count(*) AS n, 60e0 AS sfreq, round(arg_min(y, j), 6) AS first, round(arg_max(y, j), 6) AS last, round(sum(y * (j + 1)), 6) AS weighed FROM v GROUP BY id""")


def _projections() -> str:
    """Formulas of the projections, written out with numbers for their parameters."""
    f = 1 / 298.254
    e2 = f * (2 - f)
    e, ep2, a = math.sqrt(e2), e2 / (1 - e2), 6378137.0
    arc = lambda p: f"({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r}::DOUBLE * {p} - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r}::DOUBLE * sin(2 * {p}) + {15 * e2**2 / 256 + 45 * e2**3 / 1024!r}::DOUBLE * sin(4 * {p}) - {35 * e2**3 / 3072!r}::DOUBLE * sin(6 * {p}))"
    p0, p1, p2 = (math.radians(x) for x in (46.8, 46.0, 47.5))
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big, c, s = a * m(p1) / (n * t(p1) ** n), math.cos(math.radians(30.0)), math.sin(math.radians(30.0))
    turn = lambda x, y, s: (f"({x} * {c!r}::DOUBLE + {y} * ({s!r})::DOUBLE)", f"({y} * {c!r}::DOUBLE - {x} * ({s!r})::DOUBLE)")
    fx, fy = turn("ux", "uy", s)
    bx, by = turn("fx", "fy", -s)
    flat = repr(math.pi * 6371.0 / 180.0) + "::DOUBLE"
    # short distances: geocentric latitudes by the ratio of tangents
    near, far = (math.atan(0.99330647 * math.tan(math.radians(p))) for p in (46.8, 47.8))
    r = 6378.135 * (1 - math.sin(near) ** 2 / 298.26)
    per_lat, per_lon = r * (far - near), r * math.acos(1 - (1 - math.cos(math.radians(1))) * math.cos(near) ** 2) / math.cos(near)
    sx, sy = turn("gx", "gy", s)
    return f"""{BASE}, p AS (SELECT id, latitude, longitude, radians(latitude) AS phi, longitude - 8.4e0 AS dl, (longitude - 8.4e0) * {flat} * cos(radians(latitude)) AS ux, (latitude - 46.8e0) * {flat} AS uy,
  (longitude - 8.4e0) * {per_lon!r}::DOUBLE * cos(atan(0.99330647e0 * tan(radians((latitude + 46.8e0) / 2)))) AS gx, (latitude - 46.8e0) * {per_lat!r}::DOUBLE AS gy FROM ev),
q AS (SELECT *, {fx} AS fx, {fy} AS fy, {a}::DOUBLE / sqrt(1 - {e2!r}::DOUBLE * pow(sin(phi), 2)) AS nn, pow(tan(phi), 2) AS t, {ep2!r}::DOUBLE * pow(cos(phi), 2) AS c, radians(dl) * cos(phi) AS k, {n!r}::DOUBLE * radians(dl) AS th,
  {big!r}::DOUBLE * pow(tan(pi() / 4 - phi / 2) / pow((1 - {e!r}::DOUBLE * sin(phi)) / (1 + {e!r}::DOUBLE * sin(phi)), {e / 2!r}::DOUBLE), {n!r}::DOUBLE) AS rho,
  {angle('46.8e0', '8.4e0', 'latitude', 'longitude')} * {R} AS d, {az('46.8e0', '8.4e0', 'latitude', 'longitude')} AS az FROM p)
SELECT id, round(fx, 6) AS flat_x, round(fy, 6) AS flat_y,
  round(nn * (k + (1 - t + c) * pow(k, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {ep2!r}::DOUBLE) * pow(k, 5) / 120) / 1e3, 6) AS tm_x,
  round(({a}::DOUBLE * {arc('phi')} - {a}::DOUBLE * {arc(repr(p0) + '::DOUBLE')} + nn * tan(phi) * (k * k / 2 + (5 - t + 9 * c + 4 * c * c) * pow(k, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {ep2!r}::DOUBLE) * pow(k, 6) / 720)) / 1e3, 6) AS tm_y,
  round(rho * sin(th) / 1e3, 6) AS lcc_x, round(({big * t(p0) ** n!r}::DOUBLE - rho * cos(th)) / 1e3, 6) AS lcc_y,
  round(d * sin(az), 6) AS aeqd_x, round(d * cos(az), 6) AS aeqd_y, round({sx}, 6) AS sdc_x, round({sy}, 6) AS sdc_y,
  {", ".join(f"round(latitude, 6) AS {n}_lat, round(longitude, 6) AS {n}_lon" for n in ("tm", "lcc", "aeqd", "sdc"))},
  round(46.8e0 + {by} / {flat}, 6) AS lat, round(8.4e0 + {bx} / ({flat} * cos(radians(46.8e0 + {by} / {flat}))), 6) AS lon
FROM q"""


add("map_projections", _projections())


def _geodesic(rounds: int = 8) -> str:
    """Vincenty's iteration, written out; good for points that aren't opposite each other."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    lit = lambda v: f"{v!r}::DOUBLE"
    text = f"""u AS (SELECT *, atan({lit(1 - f)} * tan(radians(lat1))) AS u1, atan({lit(1 - f)} * tan(radians(lat2))) AS u2, radians(lon2 - lon1) AS len FROM m),
l0 AS (SELECT *, len AS lam FROM u)"""
    for k in range(rounds):
        text += f""",
a{k} AS (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM l{k}),
b{k} AS (SELECT *, atan2(ss, cs) AS sig, CASE WHEN ss = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM a{k}),
c{k} AS (SELECT *, 1 - sa * sa AS ca2 FROM b{k}),
d{k} AS (SELECT *, CASE WHEN ca2 <= 1e-15 THEN 0e0 ELSE cs - 2 * sin(u1) * sin(u2) / ca2 END AS cm, {lit(f / 16)} * ca2 * (4 + {lit(f)} * (4 - 3 * ca2)) AS c FROM c{k}),
l{k + 1} AS (SELECT * EXCLUDE (lam, ss, cs, sig, sa, ca2, cm, c), len + (1 - c) * {lit(f)} * sa * (sig + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS lam FROM d{k})"""
    k = rounds - 1
    return text + f""",
e AS (SELECT *, ca2 * {lit((a * a - b * b) / (b * b))} AS k FROM d{k}),
f AS (SELECT *, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS w FROM e),
g AS (SELECT *, {lit(b)} * (1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))) * (sig - w * ss * (cm + w / 4 * (cs * (2 * cm * cm - 1) - w / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS epi FROM f)"""


add("catalog_compare", f"{BASE}, m AS (SELECT a.id, b.id AS b_id, b.t_us - a.t_us AS time_us, a.latitude AS lat1, a.longitude AS lon1, b.latitude AS lat2, b.longitude AS lon2, (b.depth - a.depth) * 1e3 AS dep, count(*) OVER (PARTITION BY a.id) AS n FROM ev a JOIN ev2 b ON abs(a.t_us - b.t_us) < 250000), {_geodesic()} SELECT e.id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, b_id, time_us, round(epi, 3) AS epi_m, round(dep, 3) AS depth_m, round(sqrt(epi * epi + dep * dep), 3) AS hypo_m FROM ev e LEFT JOIN g ON g.id = e.id")

_RECORDS = """re AS (SELECT id, r, CASE WHEN id % 3 = 0 THEN r * 14 WHEN id % 3 = 1 THEN r * 16 ELSE r * 16 + CASE WHEN r >= 2 THEN 5 ELSE 0 END END AS f, s FROM tr, (SELECT unnest(range(4)) AS r)),
rs AS (SELECT id, f, list_slice(s, f + 1, least(f + 16, len(s))) AS x FROM re WHERE f < len(s)),
rr AS (SELECT *, max(f + len(x)) OVER (PARTITION BY id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rs),
rg AS (SELECT *, sum(CASE WHEN reach IS NULL OR f > reach THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY f) AS segment, greatest(0, coalesce(reach, f) - f) AS cut FROM rr),
sa AS (SELECT id, segment, f + i AS i, x[i + 1] AS v, id * 1000000 + (f + i) * 10000 AS t FROM (SELECT *, unnest(range(len(x))) AS i FROM rg) WHERE i >= cut)"""
add("record_traces", f"WITH {TRACES}, {_RECORDS} SELECT id, CAST(segment AS BIGINT) AS segment, t // 250000 AS stretch, min(t) AS start_us, max(t) + 10000 AS end_us, count(*) AS n, round(first(v ORDER BY i), 6) AS first, round(sum(v ORDER BY i), 6) AS total FROM sa GROUP BY id, segment, t // 250000")
add("trace_windows", f"""WITH {TRACES}, {_RECORDS}, q AS (SELECT id, id * 1000000 + id % 7 * 30000 + 5000 AS a FROM tr), w AS (SELECT id, a, a + 150000 + id % 5 * 60000 AS b FROM q),
g AS (SELECT id, segment, min(t) AS f, max(t) + 10000 AS l FROM sa GROUP BY 1, 2),
h AS (SELECT w.*, greatest(0, least(l, b) - greatest(f, a)) AS c, segment, f, l FROM w JOIN g ON g.id = w.id),
k AS (SELECT id, any_value(a) AS a, any_value(b) AS b, sum(c) / any_value(b - a)::DOUBLE AS av, count(*) FILTER (WHERE c > 0) AS n, min(segment) FILTER (WHERE c > 0) AS one FROM h GROUP BY id),
y AS (SELECT k.*, f, l, f + CAST(floor((a - f) / 1e4) AS BIGINT) * 10000 AS lo, f + CAST(ceil((b - f) / 1e4) AS BIGINT) * 10000 AS hi FROM k LEFT JOIN g ON g.id = k.id AND g.segment = k.one),
z AS (SELECT *, CASE WHEN n = 0 THEN 'no_data' WHEN av < 0.95e0 THEN 'low_availability' WHEN n > 1 THEN 'gaps' WHEN lo < f OR hi >= l THEN 'short' ELSE 'ok' END AS status FROM y)
SELECT z.id, status, round(av, 6) AS availability, CASE WHEN status = 'ok' THEN lo END AS trace_start_us, CASE WHEN status = 'ok' THEN (hi - lo) // 10000 + 1 END AS n,
  round(p.v, 6) AS first, round(e.v, 6) AS last FROM z LEFT JOIN sa p ON p.id = z.id AND p.t = z.lo AND status = 'ok' LEFT JOIN sa e ON e.id = z.id AND e.t = z.hi AND status = 'ok'""")
add("growing_requests", f"""{BASE}, q AS MATERIALIZED (SELECT station_id, a, a + 45000000 AS b, c, row_number() OVER (PARTITION BY station_id ORDER BY a) AS i FROM (SELECT station_id, t_us - 20000000 AS a, count(*) AS c FROM ph GROUP BY 1, 2)),
f AS (SELECT station_id, i, a, b, c, 1 AS run FROM q WHERE i = 1 UNION ALL
  SELECT q.station_id, q.i, CASE WHEN q.a <= f.b + 0.1e0 * (f.b - f.a) THEN f.a ELSE q.a END, CASE WHEN q.a <= f.b + 0.1e0 * (f.b - f.a) THEN greatest(f.b, q.b) ELSE q.b END, q.c, f.run + CASE WHEN q.a <= f.b + 0.1e0 * (f.b - f.a) THEN 0 ELSE 1 END
  FROM f JOIN q ON q.station_id = f.station_id AND q.i = f.i + 1)
SELECT station_id, min(a) AS start_us, max(b) AS end_us, CAST(sum(c) AS BIGINT) AS n FROM f GROUP BY station_id, run""")
add("interval_join", f"{BASE} SELECT a.event_id, a.seq AS manual, b.seq AS automatic, b.created_s - a.created_s AS after_s FROM o a LEFT JOIN o b ON b.event_id = a.event_id AND b.mode = 'automatic' AND b.created_s BETWEEN a.created_s AND a.created_s + 1800 WHERE a.mode = 'manual'")
add("sql_functions", f"""{BASE}, {pairs(3)}, n AS (SELECT ref_id, neigh_id, distance, row_number() OVER (PARTITION BY ref_id ORDER BY distance, neigh_id) AS rank FROM pairs)
SELECT ref_id, neigh_id, rank, round(distance, 6) AS distance, round({km("a.latitude", "a.longitude", "b.latitude", "b.longitude", "a.depth")}, 6) AS flat, round({wrap(f"degrees({az('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')})")}, 6) AS azimuth,
  round(a.longitude + degrees(atan2(sin(radians(350e0)) * sin(12e0 / ({R} - 5e0)) * cos(radians(a.latitude)), cos(12e0 / ({R} - 5e0)) - sin(radians(a.latitude)) * (sin(radians(a.latitude)) * cos(12e0 / ({R} - 5e0)) + cos(radians(a.latitude)) * sin(12e0 / ({R} - 5e0)) * cos(radians(350e0))))), 6) AS moved,
  round((a.depth + b.depth) / 2 * 0.75e0 + (a.latitude + b.longitude) / 2 * 0.25e0, 6) AS mixed, round({wrap("degrees(atan2(sin(radians(350e0)) + sin(radians(a.depth)), cos(radians(350e0)) + cos(radians(a.depth))))")}, 6) AS middle
FROM n JOIN ev a ON a.id = ref_id JOIN ev b ON b.id = neigh_id WHERE rank <= 4""")


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
