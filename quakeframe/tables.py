"""Intermediate tables in a folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session that doesn't set it gets a temporary folder, as its executors
    are the driver's process; on a cluster it has to be set."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them see")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="spark-")
    return _OWN["dir"]


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage: a lost executor costs no more than what reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.settled_at = path
    return found


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """df as a table of the session's catalog, dealt by ``by``: joins and sums on that column don't shuffle it again."""
    spark, name = df.sparkSession, f"quakeframe_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).format("parquet").saveAsTable(name)
    found = spark.table(name)
    found.saved_as = name
    return found


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that ``settled`` or ``bucketed`` made and nothing reads any more."""
    for t in tables:
        if t is None:
            continue
        spark = t.sparkSession
        if hasattr(t, "saved_as"):
            spark.sql(f"DROP TABLE IF EXISTS {t.saved_as}")
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(t.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
