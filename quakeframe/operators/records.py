"""Records to contiguous traces, and the windows that may be loaded from them.

A record is a row with the stream's keys, start_us, sfreq and samples; records may overlap, repeat, or leave gaps. They are put together in
order: what an earlier record has already is trimmed, a gap of more than half a sample starts a segment, and segments are kept
in pieces that lie in one stretch of time each, so neither a segment of days nor a stream of years is one row or one task's group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A stretch of time in microseconds.
STRETCH_US = 3_600_000_000
DAY_US = 86_400_000_000
OK, NO_DATA, FEW_DATA, GAPS, SHORT = "ok", "no_data", "low_availability", "gaps", "short"


def _span(n: Column, sfreq: Column) -> Column:
    """Microseconds that some samples take."""
    return F.round(n * 1e6 / sfreq).cast("bigint")


def assembled(records: DataFrame, keys: list[str], stretch_us: int = STRETCH_US) -> DataFrame:
    """(keys, sfreq, segment, stretch, start_us, end_us, samples): pieces of contiguous segments, in which ``segment`` counts from 1 for each stream and
    rate and end_us is that of the last sample's time and one sample more. Without samples or a rate a record is left out.

    How far earlier records reach is a running maximum of each day, carried over days, so a stream's records are dealt to many tasks."""
    keys = [*keys, "sfreq"]
    rows = records.where("sfreq > 0 and size(samples) > 0").select(*keys, "start_us", "samples", F.floor(F.col("start_us") / DAY_US).alias("_day"))
    rows = rows.withColumn("_end", F.col("start_us") + _span(F.size("samples"), F.col("sfreq")))
    order = Window.partitionBy(*keys, "_day").orderBy("start_us", F.desc("_end"), "samples")
    days = rows.groupBy(*keys, "_day").agg(F.max("_end").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", F.max("_top").over(earlier).alias("_carried"))
    rows = rows.join(days, [*keys, "_day"]).withColumn("_reach", F.greatest(F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried")))
    half = 0.5e6 / F.col("sfreq")
    fresh = F.when(F.col("_reach").isNull() | (F.col("start_us") > F.col("_reach") + half), 1).otherwise(0)
    cut = F.when(F.col("_reach").isNull(), 0).otherwise(F.greatest(F.lit(0), F.round((F.col("_reach") - F.col("start_us")) * F.col("sfreq") / 1e6))).cast("int")
    rows = rows.withColumns({"_fresh": fresh, "_cut": cut})
    starts = rows.groupBy(*keys, "_day").agg(F.sum("_fresh").alias("_n")).select(*keys, "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    rows = rows.join(starts, [*keys, "_day"]).withColumn("segment", F.col("_base") + F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(F.col("_cut") < F.size("samples"))
    rows = rows.select(*keys, "segment", (F.col("start_us") + _span(F.col("_cut"), F.col("sfreq"))).alias("_at"), F.slice("samples", F.col("_cut") + 1, F.size("samples") - F.col("_cut")).alias("_s"))

    # records are cut where stretches end: sample i belongs to the stretch that holds its time
    last = F.col("_at") + _span(F.size("_s") - 1, F.col("sfreq"))
    rows = rows.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("_at") / stretch_us), F.floor(last / stretch_us))))
    first = lambda edge: F.greatest(F.lit(0), F.ceil((edge - F.col("_at")) * F.col("sfreq") / 1e6 - 1e-6)).cast("int")
    rows = rows.withColumns({"_i": first(F.col("stretch") * stretch_us), "_j": F.least(F.size("_s"), first((F.col("stretch") + 1) * stretch_us))}).where("_j > _i")
    part = F.struct((F.col("_at") + _span(F.col("_i"), F.col("sfreq"))).alias("at"), F.slice("_s", F.col("_i") + 1, F.col("_j") - F.col("_i")).alias("s"))
    found = rows.groupBy(*keys, "segment", "stretch").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    samples = F.flatten(F.col("_parts.s"))
    return found.select(*keys, "segment", "stretch", F.col("_parts")[0]["at"].alias("start_us"), samples.alias("samples")).select(*keys, "segment", "stretch", "start_us", (F.col("start_us") + _span(F.size("samples"), F.col("sfreq"))).alias("end_us"), "samples")


def loaded(requests: DataFrame, pieces: DataFrame, keys: list[str], least: float = 0.95, stretch_us: int = STRETCH_US) -> DataFrame:
    """requests (request_id, keys, start_us, end_us) with ``status``, availability, and, if it is "ok", sfreq, trace_start_us and samples: those from the last
    sample at or before the window's start to the first at or after its end. A window has too few data if its segments cover less than ``least`` of it,
    gaps if two of them lie in it, and is short if its only one doesn't hold it whole."""
    about = 2_000_000  # a sample before and after, at rates down to one in two seconds
    asked = requests.withColumn("stretch", F.explode(F.sequence(F.floor((F.col("start_us") - about) / stretch_us), F.floor((F.col("end_us") + about) / stretch_us))))
    own = pieces.select(*keys, "sfreq", "segment", "stretch", F.col("start_us").alias("_from"), F.col("end_us").alias("_to"), F.col("samples").alias("_s"))
    hit = asked.join(own, [*keys, "stretch"]).where((F.col("_to") > F.col("start_us") - about) & (F.col("_from") < F.col("end_us") + about))
    covered = F.greatest(F.lit(0), F.least("_to", "end_us") - F.greatest("_from", "start_us"))
    inside = F.when(covered > 0, F.struct("sfreq", "segment"))
    grouped = hit.groupBy("request_id").agg(
        F.sum(covered).alias("_covered"), F.count_distinct(inside).alias("_segments"), F.min(inside).alias("_one"),
        F.array_sort(F.collect_list(F.struct("_from", "sfreq", "segment", "_s"))).alias("_parts"),
    )
    rows = requests.join(grouped, "request_id", "left")
    one = F.filter("_parts", lambda p: (p["sfreq"] == F.col("_one.sfreq")) & (p["segment"] == F.col("_one.segment")))
    rows = rows.withColumn("_parts", one).withColumns({"_start": F.col("_parts")[0]["_from"], "_all": F.flatten(F.col("_parts._s")), "sfreq": F.col("_one.sfreq"), "availability": F.coalesce(F.col("_covered") / (F.col("end_us") - F.col("start_us")), F.lit(0.0))})
    lo = F.floor((F.col("start_us") - F.col("_start")) * F.col("sfreq") / 1e6 + 1e-6)
    hi = F.ceil((F.col("end_us") - F.col("_start")) * F.col("sfreq") / 1e6 - 1e-6)
    whole = (lo >= 0) & (hi < F.size("_all"))
    status = F.when(F.coalesce("_segments", F.lit(0)) == 0, NO_DATA).when(F.col("availability") < least, FEW_DATA).when(F.col("_segments") > 1, GAPS).when(~whole, SHORT).otherwise(OK)
    rows = rows.withColumn("status", status)
    if_ok = lambda c: F.when(F.col("status") == OK, c)
    return rows.select(*requests.columns, "status", "availability", if_ok(F.col("sfreq")).alias("sfreq"), if_ok(F.col("_start") + _span(lo, F.col("sfreq"))).alias("trace_start_us"), if_ok(F.slice("_all", (lo + 1).cast("int"), (hi - lo + 1).cast("int"))).alias("samples"))
