"""Importance resampling: documents drawn so that their hashed n-grams look like a target's.

A text's words are runs of letters and digits (all of Unicode beyond ASCII counts as letters), its features runs of up to ``n`` words,
each dealt to one of ``buckets`` by its CRC-32. Blocks of documents become inverted postings: for each bucket the documents of the
block that have it, and how often. Postings are shuffled by bucket and meet there the bucket's totals in the corpus and in the target, from
which the bucket's gain is worked out where it is used: log of its smoothed share in the target over that in the corpus, in
thousandths. What a bucket adds to a document goes on to the document, added up per partition before the second shuffle. A document's weight is the
floored mean gain of its features; a Gumbel variate from a hash of the seed and doc_id is added, and the highest of the documents with enough words
are drawn, which is sampling without replacement in proportion to the exponential of the weights.

A bucket that every document has is dealt by block to ``SALTS`` parts, its totals going to each; no list is longer than a block's documents.

Defined results: a null or empty text, or one without words, has no features, weight 0, and isn't drawn; equal scores are drawn by smaller doc_id, then by
place; rows with equal doc_id are weighed each and have the same variate; a null doc_id has that of an empty one and comes last among ties. An empty
target or empty corpus has gains of smoothing alone; an empty table gives an empty one. Very long texts and words count whole. Columns other than
doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.operators.stats import ranked

from .common import written
from .texthash import chunks, flat_ranges

#: Bytes of text of a block.
BLOCK = 8 << 20
#: Parts that the blocks of a bucket are dealt to.
SALTS = 16
POSTINGS = "kind int, block long, bucket int, docs array<int>, counts array<int>, total long, doc int, doc_id long, n_words long, n_features long"
#: Spans up to so many bytes are hashed side by side, longer ones by themselves.
SHORT = 64


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


CRC = crc_table()


def span_crcs(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``buf``, a byte of all spans at a time."""
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    long = int(np.searchsorted(-n, -SHORT))  # those of more than SHORT bytes come first
    crc = np.full(len(s), 0xFFFFFFFF, np.uint32)
    edges = np.searchsorted(-n[long:], -np.arange(SHORT), "left").tolist()  # how many have more than k bytes
    for k, m in enumerate(edges):
        if not m:
            break
        c = crc[long : long + m]
        crc[long : long + m] = CRC[(c ^ buf[s[long : long + m] + k]) & 255] ^ (c >> np.uint32(8))
    crc = ~crc
    for i in range(long):
        crc[i] = zlib.crc32(buf[s[i] : s[i] + n[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, and of each feature its text and its CRC-32."""
    joined = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    low = np.where((joined >= 65) & (joined <= 90), joined | 32, joined)
    inside = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    start, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    row = np.searchsorted(ends, start, "right")
    rows, found = [row], [span_crcs(low, start, size)]
    if n > 1:  # words with one space between them, so that a run is a span
        at = np.append(0, np.cumsum(size + 1))
        plain = np.full(at[-1], 32, np.uint8)
        plain[flat_ranges(at[:-1], size)] = low[flat_ranges(start, size)]
        for k in range(2, n + 1):
            i = np.flatnonzero(row[k - 1 :] == row[: max(len(row) - k + 1, 0)]) if len(row) >= k else np.zeros(0, np.int64)
            rows.append(row[i])
            found.append(span_crcs(plain, at[i], at[i + k] - 1 - at[i]))
    return np.bincount(row, minlength=len(texts)), np.concatenate(rows), np.concatenate(found)


def postings(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Kind 0: a document of a block, with its numbers of words and features; kind 1: a bucket's documents in a block and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in chunks(texts, BLOCK):
                part = texts[lo:hi]
                words, row, crc = features(part, n)
                n_docs = hi - lo
                n_features = np.bincount(row, minlength=n_docs)
                none = pa.nulls(n_docs, pa.list_(pa.int32()))
                ints = lambda x, t: pa.array(x.astype(t))
                same = lambda x, t, k: pa.array(np.full(k, x, t))
                names = [x.strip().split()[0] for x in POSTINGS.split(",")]
                yield pa.RecordBatch.from_arrays([same(0, np.int32, n_docs), same(block, np.int64, n_docs), pa.nulls(n_docs, pa.int32()), none, none, pa.nulls(n_docs, pa.int64()), ints(np.arange(n_docs), np.int32), batch.column(0).slice(lo, n_docs), ints(words, np.int64), ints(n_features, np.int64)], names=names)
                code, count = np.unique((crc % np.uint32(buckets)).astype(np.int64) * n_docs + row, return_counts=True)
                bucket, doc = code // n_docs, code % n_docs
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                k, offsets = len(first), pa.array(np.append(first, len(code)).astype(np.int32))
                total = np.diff(np.append(0, np.cumsum(count))[np.append(first, len(code))])
                lists = [pa.ListArray.from_arrays(offsets, ints(x, np.int32)) for x in (doc, count)]
                yield pa.RecordBatch.from_arrays([same(1, np.int32, k), same(block, np.int64, k), ints(bucket[first], np.int32), *lists, ints(total, np.int64), pa.nulls(k, pa.int32()), *(pa.nulls(k, pa.int64()) for _ in range(3))], names=names)
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, POSTINGS)


def totals(posted: DataFrame, name: str) -> DataFrame:
    """(bucket, name): features in each bucket."""
    return posted.where("kind = 1").groupBy("bucket").agg(F.sum("total").alias(name))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of each document; ``target`` has a column text."""
    spark = docs.sparkSession
    ours = written(postings(docs, n, buckets), "postings", ("kind",))
    wanted = written(totals(postings(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets), "t"), "target-totals")
    both = written(totals(ours, "s").join(wanted, "bucket", "full").select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t"))), "bucket-totals")  # a row for each bucket
    all_s, all_t = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in ("s", "t"))).first()

    salt = F.pmod("block", F.lit(SALTS))
    met = both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))).hint("shuffle_hash")
    listed = ours.where("kind = 1").select("bucket", salt.alias("salt"), "block", "docs", "counts").join(met, ["bucket", "salt"])
    share = (F.col("t") + 1.0) * F.lit(all_s + buckets) / ((F.col("s") + 1.0) * F.lit(all_t + buckets))
    gain = F.floor(F.lit(1000.0) * F.log(share))
    given = listed.select("block", gain.alias("gain"), F.inline(F.arrays_zip("docs", "counts")).alias("doc", "count"))
    given = given.select("block", "doc", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_features"), (F.col("gain") * F.col("count")).alias("given"))
    own = ours.where("kind = 0").select("block", "doc", "doc_id", "n_words", "n_features", F.lit(0).cast("long").alias("given"))
    found = own.unionByName(given).groupBy("block", "doc").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("given").alias("given"))

    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(given - pmod(given, n_features)) div n_features")).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    variate = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = found.select("block", "doc", "doc_id", "n_features", (F.col("n_words") < least_words).alias("short"), weight.alias("weight"))
    scored = written(scored.withColumn("score", F.col("weight") + variate).withColumn("last", -F.col("score")).withColumn("none", F.col("doc_id").isNull()), "scored")
    drawn = scored.where("not short").count() * percent // 100
    rank = F.when(~F.col("short") & (F.col("_rank") <= drawn), F.col("_rank")).cast("long")
    return ranked(scored, ["short", "last", "none", "doc_id", "block", "doc"]).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
