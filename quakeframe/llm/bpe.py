"""Byte-level BPE: encoding by one global shuffle of distinct words, decoding by the token-byte table.

A block is some megabytes of documents. Its pre-tokens are numbered by word, position by position, and grouped
by word, so a block has one entry for each distinct word. Entries go to the word's bucket, packed in one
row for each block and bucket; there each distinct word is encoded once, however many blocks have
it (of a great many words those that have been seen lately are remembered, so that a task's memory is bounded), and the ids go back to the block, where documents are put together by position. A word that makes up a
third of all text is still one entry a block. A block has a fixed size (a longer text is a block by
itself), so no group is larger than that.

Decoding joins ids with the token-byte table, which is as large as the vocabulary file (some 50,000
entries; it is read once, on the driver, and broadcast).

Letters, digits and spaces are those of the library's version of Unicode: it is asked for them, and what the splitter here would take for
something else is split by a stand-in of the right class.

Defined results: an empty table gives an empty one; a null or empty text has no ids and decodes to no bytes; repeated rows, also with
equal or null doc_id, are encoded each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gives_back
from .merges import Remembered
from .texthash import chunks, flat_ranges, from_varint, span_hashes, to_varint

BLOCK = 8 << 20
#: Ids that are decoded at once.
DECODED = 1 << 20
#: Unicode White_Space, as \s of the library's pattern engine has it.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A letter, a digit, a space and another sign that every version of Unicode has, for those that the splitter here takes for something else.
LETTER, DIGIT, BLANK, SIGN = "\u4e00", "\u0660", "\u2003", "\u2603"
_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=None)
def stand_ins() -> dict[int, str]:
    """Code points that the library's version of Unicode puts in another class than the splitter's, with a character of the library's class. The library is asked for its classes: of a text of all code points it gives the bytes of those that a class matches."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))

    def library(cls: str) -> set[str]:
        own = tiktoken.Encoding("class", pat_str=cls, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return set(bytes(own.encode_ordinary(every)).decode())

    pairs = [(LETTER, library(r"\p{L}"), set(regex.findall(r"\p{L}", every))), (DIGIT, library(r"\p{N}"), set(regex.findall(r"\p{N}", every))), (BLANK, library(r"\s"), set(regex.findall(f"[{SPACE}]", every)))]
    return {ord(c): next((s for s, theirs, _ in pairs if c in theirs), SIGN) for c in set().union(*(theirs ^ ours for _, theirs, ours in pairs))}


class Splitter:
    """Splits texts by a pattern of letters, digits and spaces as the library does."""

    def __init__(self, pattern: str, own: dict[int, str] | None = None):
        """``own``: what ``stand_ins`` gives, if another process has worked it out."""
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.stand_ins = stand_ins() if own is None else own
        self.strange = set(map(chr, self.stand_ins))

    def findall(self, text: str) -> list[str]:
        if text.isascii() or self.strange.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_ins))]


def encoding(key: str, ranks: Broadcast, pattern: str) -> tiktoken.Encoding:
    """The library's encoding; built once for each ``key`` in each Python worker."""
    if key not in _ENCODINGS:
        _ENCODINGS.clear()
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
    return _ENCODINGS[key]


def pack(numbers: np.ndarray, rest: bytes = b"") -> bytes:
    body = to_varint(numbers)
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(body)) + body + rest)


def unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    return from_varint(raw[4 : 4 + n]), raw[4 + n :]


def words_of(block: list[str | None], split: Splitter, buckets: int) -> tuple[list[int], np.ndarray, list[tuple[int, bytes]]]:
    """Number of pre-tokens of each text, the word at each position of the block, and for each bucket its packed words, the
    commonest first. Word j of bucket k goes by the number j * buckets + k, so that common words have small numbers."""
    counts, found, packed = [], [], []
    for text in block:
        got = split.findall(text) if text else []
        counts.append(len(got))
        found += got
        if len(found) > 100_000:  # a Python string takes some ten times its bytes
            packed.append(pa.array(found, pa.string()))
            found = []
    packed.append(pa.array(found, pa.string()))
    coded = pa.concat_arrays(packed).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    del found, packed, coded
    if not len(words):
        return counts, np.zeros(0, np.int64), []
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
    text = np.frombuffer(words.buffers()[2], np.uint8, ends[-1])
    bucket = (span_hashes(text, ends[:-1], ends[1:]) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((-np.bincount(codes, minlength=len(words)), bucket))
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    number = np.empty_like(order)
    number[order] = (np.arange(len(order)) - edge[bucket[order]]) * buckets + bucket[order]
    size = np.diff(ends)[order]
    sorted_text = text[flat_ranges(ends[order], size)].tobytes()
    at_text = np.append(0, np.cumsum(size))
    out = []
    for k in np.flatnonzero(np.diff(edge)).tolist():
        a, b = edge[k], edge[k + 1]
        out.append((k, pack(np.concatenate([[b - a], size[a:b]]), sorted_text[at_text[a] : at_text[b]])))
    return counts, number[codes], out


def split_words(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """(block, bucket, payload): packed words; a negative bucket has the block's documents and the word at each position."""

    known = docs.sparkSession.sparkContext.broadcast(stand_ins())  # some 20,000 characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block = Splitter(pattern, known.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in chunks(texts, BLOCK):
                counts, at, rows = words_of(texts[lo:hi], split, buckets)
                null = np.array([x is None for x in ids[lo:hi]], np.int64)
                raw = np.array([x or 0 for x in ids[lo:hi]], "<i8").tobytes()
                rows.append((-1 - block % buckets, pack(np.concatenate([[hi - lo], counts, null, at]), raw)))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(rows), pa.int64()), "bucket": pa.array([k for k, _ in rows], pa.int32()), "payload": pa.array([p for _, p in rows], pa.binary())})
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(gives_back(run), "block long, bucket int, payload binary")


def encode_words(words: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """Payloads with ids in place of words; needs all rows of a bucket in one partition."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoding(key, ranks, pattern), Remembered()
        for batch in batches:
            out = []
            for bucket, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket < 0:
                    out.append(payload)
                    continue
                numbers, text = unpack(payload)
                n = int(numbers[0])
                ends = np.append(0, np.cumsum(numbers[1 : n + 1])).astype(np.int32)
                got = []
                for word in pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(text)).to_pylist():
                    ids = known.get(word)
                    if ids is None:
                        ids = known.young[word] = tuple(enc.encode_ordinary(word))
                    got.append(ids)
                known.turn()
                size = np.fromiter(map(len, got), np.int64, n)
                flat = np.fromiter(chain.from_iterable(got), np.int64, int(size.sum()))
                out.append(pack(np.concatenate([[n], size]), flat.astype("<u4" if enc.n_vocab > 1 << 16 else "<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "payload"])

    return words.mapInArrow(gives_back(run), "block long, bucket int, payload binary")


def reassemble(coded: DataFrame, wide: bool, buckets: int) -> DataFrame:
    """(doc_id, ids) of each document of each block."""

    def run(block: pa.Table) -> pa.Table:
        base, n_words, sizes, ids = np.zeros(buckets, np.int64), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for bucket, payload in zip(block.column("bucket").to_pylist(), block.column("payload").to_pylist(), strict=True):
            numbers, raw = unpack(payload)
            if bucket < 0:
                head, doc_ids = numbers, np.frombuffer(raw, "<i8")
                continue
            base[bucket] = n_words
            n_words += int(numbers[0])
            sizes.append(numbers[1:])
            ids.append(np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.int32))
        n_docs = int(head[0])
        counts, null, at = head[1 : n_docs + 1], head[n_docs + 1 : 2 * n_docs + 1].astype(bool), head[2 * n_docs + 1 :]
        size = np.concatenate(sizes)
        first = np.cumsum(size) - size
        word = base[at % buckets] + at // buckets
        flat = np.concatenate(ids)[flat_ranges(first[word], size[word])]
        ends = np.append(0, np.cumsum(size[word]))[np.append(0, np.cumsum(counts))]
        return pa.table({"doc_id": pa.array(doc_ids, mask=null), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))})

    return coded.groupBy("block").applyInArrow(run, "doc_id long, ids array<int>")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and ids of each document (columns doc_id, text)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * parts
    shared = spark.sparkContext.broadcast(ranks)
    words = split_words(docs, pattern, buckets).repartition(parts, "bucket")
    return reassemble(encode_words(words, shared, pattern), len(ranks) > 1 << 16, buckets)


def token_bytes(spark: SparkSession, ranks: dict[bytes, int]) -> Broadcast:
    """The token-byte table by rank: all bytes in a row, and where each token's start."""
    by_rank = sorted((r, t) for t, r in ranks.items())
    size = np.zeros(by_rank[-1][0] + 1 if by_rank else 0, np.int64)
    for r, t in by_rank:
        size[r] = len(t)
    return spark.sparkContext.broadcast((np.frombuffer(b"".join(t for _, t in by_rank), np.uint8), np.append(0, np.cumsum(size))))


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, ids and decoded (bytes) of rows with doc_id and ids."""
    shared = token_bytes(encoded.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, at = shared.value
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_pylist()
            for lo, hi in chunks([range(n) for n in sizes], DECODED):
                part = batch.slice(lo, hi - lo)
                ids = part.column(1)
                flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.diff(at)[flat]
                data = text[flat_ranges(at[flat], n)]
                lists = np.append(0, np.cumsum([len(x) if x is not None else 0 for x in ids]))
                ends = np.append(0, np.cumsum(n))[lists]
                out = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), ids, out], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(gives_back(run), "doc_id long, ids array<int>, decoded binary")
