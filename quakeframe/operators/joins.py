"""Joins in time and by symmetric keys: catalogs compared, cross-correlations looked up, validity spans, merged requests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.geodesic import geodesic_m


def time_matches(a: DataFrame, b: DataFrame, micros: int) -> DataFrame:
    """Pairs of rows of a and b (id, t_us) less than ``micros`` apart, joined on time bins of that width."""
    left = a.select([F.col(c).alias(f"a_{c}") for c in a.columns]).withColumn("bin", F.explode(F.sequence(F.floor(F.col("a_t_us") / micros) - 1, F.floor(F.col("a_t_us") / micros) + 1)))
    right = b.select([F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("bin", F.floor(F.col("b_t_us") / micros))
    return left.join(right, "bin").where(F.abs(F.col("a_t_us") - F.col("b_t_us")) < micros).drop("bin")


def compare_catalogs(a: DataFrame, b: DataFrame, micros: int) -> DataFrame:
    """For each event of a: status (missing, ambiguous or matched), and how a matched one differs in b; along the WGS84 ellipsoid."""
    found = time_matches(a, b, micros)
    n = found.groupBy("a_id").agg(F.count("*").alias("n"))
    one = found.join(n.where("n = 1").select("a_id"), "a_id", "left_semi")
    epi = geodesic_m(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude"))
    one = one.select("a_id", "b_id", (F.col("b_t_us") - F.col("a_t_us")).alias("time_us"), epi.alias("epi_m"), ((F.col("b_depth") - F.col("a_depth")) * 1000).alias("depth_m"))
    one = one.withColumn("hypo_m", F.sqrt(F.col("epi_m") * F.col("epi_m") + F.col("depth_m") * F.col("depth_m")))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return a.select(F.col("id").alias("a_id")).join(n, "a_id", "left").join(one, "a_id", "left").withColumn("status", status).drop("n").withColumnRenamed("a_id", "id")


def canonical_xcorr(rows: DataFrame, order: str) -> DataFrame:
    """Cross-correlations by least event first, lag turned where events were; of equal pairs the last row stays."""
    flip = F.col("ev1") > F.col("ev2")
    rows = rows.withColumns({"_lo": F.least("ev1", "ev2"), "_hi": F.greatest("ev1", "ev2"), "lag": F.when(flip, -F.col("lag")).otherwise(F.col("lag"))})
    w = Window.partitionBy("_lo", "_hi", "station_id", "type").orderBy(F.desc(order))
    rows = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return rows.withColumns({"ev1": F.col("_lo"), "ev2": F.col("_hi")}).drop("_lo", "_hi")


def lookup_xcorr(edges: DataFrame, cache: DataFrame) -> DataFrame:
    """Edges (ref_id, neigh_id, station_id, type) with the canonical cache's result, as seen from the reference event."""
    keyed = edges.withColumns({"ev1": F.least("ref_id", "neigh_id"), "ev2": F.greatest("ref_id", "neigh_id")})
    found = keyed.join(cache.select("ev1", "ev2", "station_id", "type", "valid", "coefficient", "lag"), ["ev1", "ev2", "station_id", "type"], "left")
    return found.withColumn("lag", F.when(F.col("ref_id") > F.col("neigh_id"), -F.col("lag")).otherwise(F.col("lag"))).drop("ev1", "ev2")


def valid_at(rows: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """rows with the span (keys, start, end or NULL) that holds their time; the latest start if several do; NULLs if none does.

    Times at which a key's spans start or end cut its time into pieces, and one span, or none, is right for all of a piece; so a row meets one
    piece: the last that starts at or before its time, carried forward in the order of time."""
    extra = [c for c in spans.columns if c not in keys]
    cuts = spans.select(*keys, F.explode(F.array(start, end)).alias("_t")).where("_t is not null").distinct()
    there = spans.join(cuts, keys).where((F.col(start) <= F.col("_t")) & (F.col(end).isNull() | (F.col("_t") < F.col(end))))
    best = there.groupBy(*keys, "_t").agg(F.max(F.struct(start, *[c for c in extra if c != start])).alias("_s"))
    pieces = cuts.join(best, [*keys, "_t"], "left").select(*keys, "_t", F.lit(0).alias("_row"), F.struct("_s").alias("_piece"))
    both = rows.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_row"), F.struct(*rows.columns).alias("_own")).unionByName(pieces, allowMissingColumns=True)
    last = F.last("_piece", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_row"))
    found = both.withColumn("_s", last["_s"]).where("_row = 1")
    return found.select(*[F.col(f"_own.{c}").alias(c) for c in rows.columns], *[F.col(f"_s.{c}").alias(c) for c in extra])


def _islands(windows: DataFrame, keys: list[str], tolerance_us: int) -> DataFrame:
    """Windows (keys, start_us, end_us, n), different ones of each key, merged where they touch."""
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = windows.withColumn("_new", F.when(F.col("start_us") <= reach + tolerance_us, 0).otherwise(1))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_g").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n")).drop("_g")


def merge_requests(requests: DataFrame, keys: list[str], tolerance_us: int = 0, slice_us: int = 86_400_000_000) -> DataFrame:
    """Windows (keys, start_us, end_us) that overlap or lie within a tolerance become one: keys, start_us, end_us, n.

    Equal windows are counted first; then those that start in one slice of time are merged, and what is left of all slices again,
    so a key with very many windows is shared out. Windows are dealt to all parts that a shuffle has: they are few bytes there, so parts would be
    put together again, but take many times that to be sorted and merged."""
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = requests.groupBy(*keys, "start_us", "end_us").agg(F.count("*").alias("n"))
    sliced = counted.withColumn("_slice", F.floor(F.col("start_us") / slice_us)).repartition(parts, *keys, "_slice")
    return _islands(_islands(sliced, [*keys, "_slice"], tolerance_us).drop("_slice").repartition(parts, *keys), keys, tolerance_us)


def merge_growing(requests: DataFrame, keys: list[str], share: float = 0.1, slice_us: int = 86_400_000_000) -> DataFrame:
    """Windows (keys, start_us, end_us) of each key as runs (keys, start_us, end_us, n): in the order of their starts a window joins the run if it begins no
    later after the run's end than ``share`` of the run's length so far.

    A run's reach grows with what has joined it, so this is a fold. It is taken over the windows of each slice of time, and then over the
    slices' runs: what joins a run by its own tolerance also joins a longer one that the run itself has joined, so a slice's runs may be
    taken as windows and the result is that of one fold over all."""
    counted = requests.groupBy(*keys, "start_us", "end_us").agg(F.count("*").alias("n")).withColumn("_slice", F.floor(F.col("start_us") / slice_us))
    columns = [*keys, "start_us", "end_us", "n"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.select(*columns).schema.fields)

    def folded(by: list[str]):
        """Runs of the windows in a partition, which has all of its groups ``by``, one after another and in order; a run goes on over batches."""

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, run = None, None
            for batch in batches:
                done = []
                own = [batch.column(k).to_pylist() for k in by]
                told = [batch.column(k).to_pylist() for k in keys]
                for *head, a, b, n in zip(*own, *told, *(batch.column(c).to_pylist() for c in columns[-3:]), strict=True):
                    if run and head == group and a <= run[-2] + share * (run[-2] - run[-3]):
                        run[-2:] = [max(run[-2], b), run[-1] + n]
                    else:
                        if run:
                            done.append(run)
                        group, run = head, [*head[len(by) :], a, b, n]
                yield _table(done)
            if run:
                yield _table([run])

        def _table(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=columns)

        types = [to_arrow_type(f.dataType) for f in counted.select(*columns).schema.fields]
        return fold

    for by in ([*keys, "_slice"], keys):
        dealt = counted.repartition(*by).sortWithinPartitions(*by, "start_us", "end_us")
        counted = dealt.mapInArrow(folded(by), schema)
    return counted


def containing_trace(requests: DataFrame, traces: DataFrame, keys: list[str], bin_us: int = 300_000_000) -> DataFrame:
    """Requests (keys, start_us, end_us) with the first trace (keys, trace_start_us, trace_end_us, trace_id) that holds them whole. Requests
    meet traces that cover the time bin they start in."""
    binned = traces.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("trace_start_us") / bin_us), F.floor(F.col("trace_end_us") / bin_us))))
    asked = requests.withColumn("_bin", F.floor(F.col("start_us") / bin_us))
    hit = asked.join(binned, [*keys, "_bin"]).where("trace_start_us <= start_us and trace_end_us >= end_us")
    rest = [c for c in traces.columns if c not in keys]
    first = F.min(F.struct("trace_start_us", "trace_id", *[c for c in rest if c not in ("trace_start_us", "trace_id")]))
    return hit.groupBy(*keys, "start_us", "end_us").agg(first.alias("_s")).select(*keys, "start_us", "end_us", *[F.col(f"_s.{c}").alias(c) for c in rest])
