"""Media columns on DataFrames: store texts as containers, read containers back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .media import UNIT, payload, probe_media, store_media

STORED = "doc_id long, n_bytes long, media binary"
PROBED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string,"
    " feature string, codec string, duration double, n_keyframes long, keyframes array<struct<offset:long,length:long>>, error string"
)


def encode_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8) and media (its container)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                raw = [x or b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([store_media(x) for x in raw], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("raw")).mapInArrow(store, STORED)


def read_media(stored: DataFrame) -> DataFrame:
    """What the containers hold: digests of the payload, codec, duration in seconds and the byte
    range of each keyframe. ``feature`` sums the track up as text."""
    names = [x.split()[0] for x in PROBED.split(", ")]
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), ranges, pa.string()]

    def one(doc_id: int | None, n_bytes: int | None, media: bytes | None) -> tuple:
        try:
            if media is None:
                raise ValueError("there is no media")
            t = probe_media(media)
        except ValueError as e:
            return (doc_id, n_bytes, None, None, None, None if media is None else len(media), None, None, None, None, None, None, str(e))
        data = payload(media, t["chunks"])
        keys = list(zip(t["key_offset"].tolist(), t["key_length"].tolist(), strict=True))
        feature = f"{t['codec'].strip()} {t['timescale']} Hz, {t['duration']} ticks, {t['n_samples']} samples, {len(t['chunks'])} chunks, {len(keys)} keyframes" + "".join(
            f", {what} {at}+{n}" for what, (at, n) in zip(("first", "last"), (keys[0], keys[-1]) if keys else (), strict=False)
        )
        return (
            doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(),
            feature, t["codec"], t["duration"] / t["timescale"] if t["timescale"] else None, len(keys), [{"offset": a, "length": n} for a, n in keys], None,
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = [one(*x) for x in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, PROBED)
