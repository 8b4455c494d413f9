"""Catalog tables derived from the star schema that the tests and benchmarks come with.

Each is one SQL text that Spark and other engines read alike: whole numbers and IEEE arithmetic only (+, -, *, /, sqrt), so
that all engines get the same values. ``{customer}`` and the like stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENT = """
SELECT id, 1577836800000000 + id * 61000000 AS t_us,
  46.5e0 + CAST((id * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.6e0 AS latitude,
  8e0 + CAST((id * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.8e0 AS longitude,
  2e0 + CAST((id * 31) % 97 AS DOUBLE) / 97e0 * 10e0 AS depth,
  CASE WHEN id % 13 = 0 THEN NULL ELSE CAST((id * 17) % 50 AS DOUBLE) / 10e0 END AS magnitude
FROM (SELECT CAST(c_custkey AS BIGINT) AS id FROM {customer})
"""

STATION = """
SELECT concat('N', CAST(n % 5 AS STRING), '.S', CAST(k AS STRING), '.') AS id,
  46.2e0 + CAST((k * 37) % 101 AS DOUBLE) / 101e0 * 1.2e0 AS latitude,
  7.6e0 + CAST((k * 53) % 103 AS DOUBLE) / 103e0 * 1.6e0 AS longitude,
  CAST((k * 71) % 2500 AS DOUBLE) AS elevation,
  concat('N', CAST(n % 5 AS STRING)) AS network, concat('S', CAST(k AS STRING)) AS station, '' AS location, k AS number
FROM (SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_nationkey AS BIGINT) AS n FROM {supplier})
"""

PHASE = f"""
SELECT e.id AS event_id, s.id AS station_id, p.type, s.network, s.station, s.location, 'HHZ' AS channel,
  e.t_us + CAST(round(sqrt((e.latitude - s.latitude) * (e.latitude - s.latitude) * 12364e0 + (e.longitude - s.longitude) * (e.longitude - s.longitude) * 5852e0
    + (e.depth + s.elevation / 1e3) * (e.depth + s.elevation / 1e3)) * 1e6 / CASE WHEN p.type = 'Sg' THEN 3.4e0 ELSE 5.8e0 END) AS BIGINT) + p.jitter AS t_us,
  CAST(p.unc AS DOUBLE) / 1e3 AS lower_unc, CAST(p.unc AS DOUBLE) / 1e3 AS upper_unc
FROM (SELECT CAST(o_custkey AS BIGINT) AS event_id, CAST(l_suppkey AS BIGINT) AS number,
    CASE l_returnflag WHEN 'A' THEN 'Pg' WHEN 'N' THEN 'Sg' ELSE 'P' END AS type,
    (min(CAST(l_orderkey AS BIGINT)) * 7919) % 40001 - 20000 AS jitter, (min(CAST(l_orderkey AS BIGINT)) * 31) % 400 AS unc
  FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey GROUP BY 1, 2, 3) p
JOIN ({EVENT}) e ON e.id = p.event_id JOIN ({STATION}) s ON s.number = p.number
"""

#: Catalog 2: some events are missing, others are shifted.
EVENT2 = f"""
SELECT id + 1000000 AS id, t_us + (id % 7) * 100000 - 300000 AS t_us, latitude + CAST(id % 3 AS DOUBLE) * 0.001e0 AS latitude, longitude, depth + 0.5e0 AS depth, magnitude
FROM ({EVENT}) WHERE id % 11 <> 0
"""

#: Origins: updates of an event's location, as messages have them.
ORIGIN = """
SELECT CAST(event_id AS BIGINT) AS seq, CAST(user_id AS BIGINT) % 500 AS event_id, CAST(user_id AS BIGINT) % 7 AS agency,
  event_type AS author, CAST(round(CAST(value AS DOUBLE) * 1e3) AS BIGINT) % 1000 AS rms_milli, (CAST(event_id AS BIGINT) * 7919) % 30 AS n_phases,
  (CAST(event_id AS BIGINT) * 104729) % 86400 AS created_s, CASE WHEN CAST(event_id AS BIGINT) % 4 = 0 THEN 'manual' ELSE 'automatic' END AS mode,
  46.4e0 + CAST((CAST(event_id AS BIGINT) * 13) % 1009 AS DOUBLE) / 1009e0 AS latitude, 7.9e0 + CAST((CAST(event_id AS BIGINT) * 29) % 1013 AS DOUBLE) / 1013e0 AS longitude
FROM {events}
"""

TABLES = ("customer", "supplier", "orders", "lineitem", "events", "embeddings")


def sql_for(text: str) -> str:
    """The text for an engine in which the tables have their own names."""
    return text.format(**{t: t for t in TABLES})


class Lens:
    """The catalog tables over the files of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def query(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if f"{{{t}}}" in text})

    @property
    def events(self) -> DataFrame:
        return self.query(EVENT)

    @property
    def stations(self) -> DataFrame:
        return self.query(STATION)

    @property
    def phases(self) -> DataFrame:
        return self.query(PHASE)

    @property
    def events2(self) -> DataFrame:
        return self.query(EVENT2)

    @property
    def origins(self) -> DataFrame:
        return self.query(ORIGIN)
