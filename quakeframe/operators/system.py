"""The double-difference system as tables: observations, their weights, constraint rows and column norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import residual_weight, xcorr_weight


def double_differences(edges: DataFrame, picks: DataFrame, xcorr: DataFrame | None = None, least: float = 0.5, scaler: float = 2.0) -> DataFrame:
    """One row for each edge: residual of the differential time, and a-priori weight.

    edges: ref_id, neigh_id, type, station_id; picks: event_id, type, station_id, travel times and residual, class_weight; xcorr as
    ``lookup_xcorr`` gives it (ref_id, neigh_id, type, station_id, valid, coefficient, lag)."""
    side = ["type", "station_id"]
    a = picks.select(F.col("event_id").alias("ref_id"), *side, F.col("residual").alias("r1"), F.col("class_weight").alias("w1"))
    b = picks.select(F.col("event_id").alias("neigh_id"), *side, F.col("residual").alias("r2"), F.col("class_weight").alias("w2"))
    rows = edges.join(a, ["ref_id", *side]).join(b, ["neigh_id", *side])
    rows = rows.withColumns({"residual": F.col("r1") - F.col("r2"), "weight": (F.col("w1") + F.col("w2")) / 2})
    if xcorr is not None:
        rows = rows.join(xcorr.select("ref_id", "neigh_id", *side, "valid", "coefficient", "lag"), ["ref_id", "neigh_id", *side], "left")
        used = F.coalesce(F.col("valid") & (F.abs("coefficient") >= least), F.lit(False))
        rows = rows.withColumns({
            "residual": F.when(used, F.col("residual") - F.col("lag")).otherwise(F.col("residual")),
            "weight": F.when(used, xcorr_weight(F.col("weight"), F.col("coefficient"), F.col("valid"), least, scaler)).otherwise(F.col("weight")),
            "xcorr_used": used,
        })
    return rows.drop("r1", "r2", "w1", "w2")


def reweighted(rows: DataFrame, cluster: str, alpha: float) -> DataFrame:
    """Weights times the bi-weight of the residuals' deviation from 0, by the cluster's median absolute deviation."""
    mid = rows.groupBy(cluster).agg(F.median("residual").alias("_m"))
    mad = rows.join(mid, cluster).groupBy(cluster).agg(F.median(F.abs(F.col("residual") - F.col("_m"))).alias("mad"))
    rows = rows.join(mad, cluster)
    return rows.withColumn("final_weight", F.col("weight") * residual_weight(F.col("residual"), F.col("mad"), alpha))


def constraint_rows(rows: DataFrame, picks: DataFrame, omega: float) -> DataFrame:
    """Absolute travel-time rows: for each event, station and type that observations use, omega times their mean weight."""
    ends = F.explode(F.array("ref_id", "neigh_id"))
    used = rows.where("final_weight > 0").select(ends.alias("event_id"), "type", "station_id", "final_weight")
    mean = used.groupBy("event_id", "type", "station_id").agg(F.count("*").alias("n"), (omega * F.avg("final_weight")).alias("weight"))
    return mean.join(picks.select("event_id", "type", "station_id", "residual"), ["event_id", "type", "station_id"])


def coefficients(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """The sparse matrix in long form: ref_id, neigh_id, type, station_id, event_id, axis (x, y, z, t), value, weighted."""
    side = ["type", "station_id"]
    p = picks.select("event_id", *side, "dx", "dy", "dz")
    both = rows.select("ref_id", "neigh_id", *side, "final_weight", F.explode(F.array(F.struct(F.col("ref_id").alias("event_id"), F.lit(1.0).alias("sign")), F.struct(F.col("neigh_id").alias("event_id"), F.lit(-1.0).alias("sign")))).alias("e"))
    both = both.select("*", "e.event_id", "e.sign").drop("e").join(p, ["event_id", *side])
    axes = F.explode(F.array(*(F.struct(F.lit(n).alias("axis"), v.alias("d")) for n, v in (("x", F.col("dx")), ("y", F.col("dy")), ("z", F.col("dz")), ("t", F.lit(1.0))))))
    both = both.withColumn("a", axes)
    return both.select("ref_id", "neigh_id", *side, "event_id", F.col("a.axis").alias("axis"), (F.col("sign") * F.col("a.d") * F.col("final_weight")).alias("value"))


def column_norms(matrix: DataFrame) -> DataFrame:
    """event_id, axis, norm of each column of the system."""
    return matrix.groupBy("event_id", "axis").agg(F.count_if(F.col("value") != 0).alias("n"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
