"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    A local session that doesn't set it (tests) gets a temporary folder; there the driver and
    the executors are one process. On a cluster it has to be set.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them see")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="spark-")
    return _OWN["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    It cuts the lineage; a lost executor costs no more than the stage that reads the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more: what was made of them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int, size: str = "4m") -> Iterator[None]:
    """Jobs that start meanwhile send Arrow batches of so many rows, and of some such size, at most: for rows with long texts."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def give_back() -> None:
    """Freed memory goes back to the system, as far as its allocators can give it back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, before and after which memory goes back: a worker lives on after its task, also while tasks of other kinds run in other
    workers of the executor, and would keep what its largest task freed."""

    @functools.wraps(run)
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return lean
