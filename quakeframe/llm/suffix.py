"""Suffix-array dedup: bytes of strings that also start in a document with a smaller id are removed.

A string of ``length`` bytes counts from where it starts. Sorting all suffixes of a corpus in one place
can't be distributed, so the work is dealt by content, without losing a match:

1. Documents are packed in blocks. In each run of consecutive starts the least hash of a ``GRAM``-byte gram inside
   the string is its anchor (the leftmost, on ties): equal strings have equal anchors at the same distance.
   Starts with one anchor are a unit, some 20 starts on average. A block tells the anchor's bucket its distinct anchors,
   and learns which of them several documents have.
2. Only units of such anchors go on: a block sends each distinct unit text, with the least id that has it,
   to its anchor's bucket. A bucket joins its units and orders their suffixes by two-stage sorting: only suffixes
   smaller than their successors are sorted directly, the others are induced by bucket scans. Adjacent common prefixes
   tell which starts have equal strings; a bit for each start is sent back: whether a smaller id has its string.
3. Blocks find their units again, mark the starts with a smaller id elsewhere, and cut what their strings cover.

A passage that a third of all documents share is one unit text a block, not one a document; a group of
thousands of copies likewise. A phrase shorter than ``length`` with other text around it in each document would be one anchor with a
unit text for each of them: anchors with more than ``hot`` units are told apart when they are reported, and their units
are cut in single strings, which go to buckets by their own hash. Groups are blocks (``BLOCK`` bytes, or one longer text) and buckets.

Defined results: a null text counts as empty; texts shorter than ``length`` bytes keep all. Rows with equal
ids don't cut each other; a row with null id neither cuts nor is cut. Other columns pass through, except any named like
the results. Cut bytes may leave part of a character: ``kept`` is binary, and ``text`` leaves such parts out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .bpe import pack, unpack
from .common import gives_back, written
from .texthash import ODD, chunks, flat_ranges, mix

BLOCK, PIECE = 4 << 20, 1 << 19
GRAM = 16
NONE = np.iinfo(np.int64).max
HASH_BITS = 48
#: Units with one anchor (some 70 bytes each) that one bucket takes.
HOT = 1 << 17
ROWS = "kind int, block long, bucket int, payload binary"


def squeeze(x: np.ndarray) -> bytes:
    """64-bit numbers, byte planes one after the other, so that high bytes that are all alike vanish."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def words_at(buf: np.ndarray, order: str = "<") -> np.ndarray:
    """The 64-bit number that starts at each byte (a view)."""
    return np.ndarray((max(0, len(buf) - 7),), f"{order}u8", buf, 0, (1,))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


class Block:
    """Distinct texts of a block in one buffer, and the units of their starts."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], length: int):
        place: dict[bytes, int] = {}
        self.text_of = [place.setdefault(t or b"", len(place)) for t in texts]
        distinct = list(place)
        size = np.array([len(t) for t in distinct], np.int64)
        self.at = np.append(0, np.cumsum(size))
        self.buf = np.frombuffer(b"".join(distinct) + bytes(8), np.uint8)
        #: least and greatest id of each distinct text; NONE and -NONE without any
        self.least, self.most = np.full(len(distinct), NONE), np.full(len(distinct), -NONE)
        known = np.array([x is not None for x in ids], bool)
        own = np.array([x or 0 for x in ids], np.int64)[known]
        where = np.array(self.text_of, np.int64)[known]
        np.minimum.at(self.least, where, own)
        np.maximum.at(self.most, where, own)
        found = [self.units_of(lo, hi, length) for lo, hi in chunks(distinct, PIECE)]
        #: first byte of each unit, its number of starts, its anchor's hash, and its text's number
        self.start, self.n, self.hash = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))
        self.owner = np.searchsorted(self.at, self.start, "right") - 1

    def units_of(self, lo: int, hi: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of some texts; a piece of the block at a time, as the hashes of all grams take many times its size."""
        w, first, n = length - GRAM + 1, int(self.at[lo]), int(self.at[hi] - self.at[lo])
        if n < length:
            return (np.zeros(0, np.int64),) * 3
        word = words_at(self.buf[first : first + n + 8])
        h = mix(mix(word[: n - GRAM + 1] * ODD) + word[GRAM - 8 : n - 7])
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        pick = (sliding_min(key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at, size = self.at[lo:hi] - first, np.diff(self.at[lo : hi + 1])
        fits = (size >= length) & (self.least[lo:hi] < NONE)
        valid = np.zeros(n - length + 1, bool)
        valid[flat_ranges(at[fits], size[fits] - length + 1)] = True
        edge = valid.copy()
        edge[1:] &= (pick[1:] != pick[:-1]) | ~valid[:-1]
        start = np.flatnonzero(edge)
        stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~edge[1:], False)) + 1
        return start + first, stop - start, (mix(h[pick[start]] + ODD) >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes in order, and a code for each: in the low bit whether several ids of this block have it, above it
        a number c for 2**c units at most (15 for any more, of which a block of ``BLOCK`` bytes has few)."""
        if not len(self.hash):
            return self.hash, np.zeros(0, np.int64)
        order = np.argsort(self.hash, kind="stable")
        h, own = self.hash[order], self.owner[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        several = np.minimum.reduceat(self.least[own], first) != np.maximum.reduceat(self.most[own], first)
        units = np.diff(np.append(first, len(h)))
        return h[first], np.minimum(np.ceil(np.log2(units)).astype(np.int64), 15) << 1 | several


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return (h >> 16) * buckets >> HASH_BITS - 16


def prefix_lengths(buf: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, ``most`` at most; buf has 8 more bytes."""
    word = words_at(buf)
    out, on = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, most, 8):
        differ = word[np.minimum(a[on] + k, len(word) - 1)] ^ word[np.minimum(b[on] + k, len(word) - 1)]
        low = differ & (~differ + np.uint64(1))
        out[on] += np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        on = on[differ == 0]
        if not len(on):
            break
    return np.minimum(out, most)


def direct_sort(buf: np.ndarray, pos: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """``pos`` in the order of the next ``depth`` bytes; bytes from ``end`` on count as 0."""
    word = words_at(buf, ">")

    def key(at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        left = np.clip(stop - at, 0, 8)
        got = word[np.minimum(at, len(word) - 1)].astype(np.uint64)
        cut = ((8 - left) * 8).astype(np.uint64)
        return np.where(left > 0, got >> np.minimum(cut, 63) << np.minimum(cut, 63), np.uint64(0))

    k = key(pos, end)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.append(True, k[1:] != k[:-1])
    for off in range(8, depth, 8):
        tied = np.flatnonzero(~first | ~np.append(first[1:], True))
        if not len(tied):
            break
        own = order[tied]
        group = np.cumsum(first[tied])
        k = key(pos[own] + off, end[own])
        by = np.lexsort((k, group))
        order[tied] = own[by]
        k, group = k[by], group[by]
        again = np.append(True, (k[1:] != k[:-1]) | (group[1:] != group[:-1]))
        first[tied] = again
    return pos[order]


def two_stage_order(buf: np.ndarray, start: np.ndarray, size: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at the first ``wanted`` bytes of each piece buf[start:start + size], ordered by their first
    ``depth`` bytes at least. A piece's end is smaller than any byte."""
    n = int(start[-1] + size[-1]) if len(start) else 0
    text, ends = buf[:n], start + size - 1
    where = np.arange(n, dtype=np.int32)

    def next_of(marks: np.ndarray) -> np.ndarray:
        """Place of the next mark, n without one."""
        return np.minimum.accumulate(np.where(marks, where, np.int32(n))[::-1])[::-1]

    # the last byte before one that differs, or before the piece's end
    closing = np.zeros(n, bool)
    closing[ends] = True
    change = next_of(np.append(text[1:] != text[:-1], True) | closing)
    smaller = ~closing[change] & (text[np.minimum(change + 1, n - 1)] > text)
    del change, closing
    # what is wanted, and what it is induced from: on to the next suffix that is sorted directly
    need = np.zeros(n, bool)
    need[flat_ranges(start, wanted)] = True
    last = start + wanted - 1
    until = np.minimum(next_of(smaller)[last], ends)
    need[flat_ranges(last, until - last + 1)] = True
    del where

    direct = np.flatnonzero(need & smaller)
    direct = direct_sort(buf, direct, ends[np.searchsorted(ends, direct)] + 1, depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger = need & ~smaller
    opening = np.zeros(n, bool)
    opening[start] = True

    def before(pos: np.ndarray) -> np.ndarray:
        """Predecessors that are to be induced, in order."""
        pos = pos[~opening[pos]] - 1
        return pos[larger[pos]]

    def give(pos: np.ndarray) -> None:
        c = text[pos]
        pos = pos[np.argsort(c, kind="stable")]
        at = np.searchsorted(np.sort(c), np.arange(257))
        for b in np.flatnonzero(np.diff(at)).tolist():
            induced[b].append(pos[at[b] : at[b + 1]])

    give(ends[larger[ends]])
    out = []
    for c in range(256):
        own = [*induced[c], np.zeros(0, np.int64)]
        fresh = np.concatenate(own)
        own = [fresh]
        while len(fresh):  # one step for each byte of a run of equal bytes
            got = before(fresh)
            fresh = got[text[got] == c]
            own.append(fresh)
        own.append(direct[edges[c] : edges[c + 1]])
        scanned = np.concatenate(own)
        out.append(scanned)
        got = before(scanned)
        give(got[text[got] > c])
    return np.concatenate(out)


def least_ids(texts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of each distinct text with ``length`` bytes after it, the least id of an equal string; and where
    each text's starts begin."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    n = size - length + 1
    buf = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    order = two_stage_order(buf, start, size, n, length)
    piece = np.searchsorted(start, order, "right") - 1
    real = order - start[piece] < n[piece]
    order, piece = order[real], piece[real]
    common = prefix_lengths(buf, order[:-1], order[1:], length)
    first = np.flatnonzero(np.append(True, common < length))
    least = np.minimum.reduceat(ids[piece], first)
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int64)
    out[at[piece] + order - start[piece]] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out, at


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "block", "bucket", "payload"])


def _texts(table: pa.Table | pa.RecordBatch) -> tuple[list[int | None], list[bytes | None]]:
    return table.column("doc_id").cast(pa.int64()).to_pylist(), table.column("text").cast(pa.binary()).to_pylist()


def _blocks(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Kind 0: a block's documents; kind 1: its anchors of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = _texts(batch)
            for lo, hi in chunks(texts, BLOCK):
                h, code = Block(ids[lo:hi], texts[lo:hi], length).anchors()
                edge = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
                rows = [(0, number, -1, _ipc(batch.slice(lo, hi - lo)))]
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    a, b = edge[k], edge[k + 1]
                    gaps = np.diff(h[a:b], prepend=0)
                    rows.append((1, number, k, squeeze(gaps << 5 | code[a:b])))
                yield _rows(rows)
                number += 1

    return docs.mapInArrow(gives_back(run), ROWS)


def _shared_anchors(rows: DataFrame, hot: int) -> DataFrame:
    """Kind 2: for each block and bucket, a bit for each anchor that several ids have, and then one for each that has more units than ``hot``."""

    def run(t: pa.Table) -> pa.Table:
        got = [unsqueeze(p).astype(np.int64) for p in t.column("payload").to_pylist()]
        n = np.array([len(x) for x in got])
        h = np.concatenate([np.cumsum(x >> 5) for x in got])
        _, which, times = np.unique(h, return_inverse=True, return_counts=True)
        code = np.concatenate(got) & 31
        several = times > 1
        several[which[code & 1 == 1]] = True
        units = np.bincount(which, np.exp2(code >> 1), len(times))
        bits, large, at = several[which], (several & (units > hot))[which], np.cumsum(n) - n
        block, bucket = t.column("block").to_pylist(), t.column("bucket").to_pylist()
        own = [slice(at[i], at[i] + n[i]) for i in range(len(n))]
        return pa.Table.from_batches([_rows([(2, block[i], bucket[i], np.packbits(np.append(bits[x], large[x])).tobytes()) for i, x in enumerate(own)])])

    return rows.groupBy("bucket").applyInArrow(run, ROWS)


def string_hashes(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes, as large as anchors', of the strings that start at these bytes."""
    word = words_at(buf)
    h = np.full(len(at), ODD)
    for k in [*range(0, length - 8, 8), length - 8]:
        h = mix(h * ODD + word[at + k])
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Candidates:
    """A block's units whose anchors several ids have; distinct texts of units are numbered by bucket."""

    def __init__(self, block: Block, bits: list[tuple[int, bytes]], length: int, buckets: int):
        h, _ = block.anchors()
        edge = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
        several, hot = np.zeros((2, len(h)), bool)
        for k, packed in bits:
            a, b = int(edge[k]), int(edge[k + 1])
            several[a:b], hot[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=2 * (b - a)).astype(bool).reshape(2, -1)
        anchor = np.searchsorted(h, block.hash)
        on = np.flatnonzero(several[anchor]) if len(h) else np.zeros(0, np.int64)
        self.start, self.n, owner, home = block.start[on], block.n[on], block.owner[on], block.hash[on]
        if hot.any():  # each string of their units by itself
            large = hot[anchor[on]]
            single = flat_ranges(self.start[large], self.n[large])
            owner = np.append(owner[~large], np.repeat(owner[large], self.n[large]))
            home = np.append(home[~large], string_hashes(block.buf, single, length))
            self.start, self.n = np.append(self.start[~large], single), np.append(self.n[~large], np.ones(len(single), np.int64))
        text, place = block.buf.tobytes(), {}
        unit = np.array([place.setdefault(text[a : a + m], len(place)) for a, m in zip(self.start.tolist(), (self.n + length - 1).tolist(), strict=True)], np.int64)
        least, bucket = np.full(len(place), NONE), np.zeros(len(place), np.int64)
        np.minimum.at(least, unit, block.least[owner])
        bucket[unit] = bucket_of(home, buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        distinct = list(place)
        #: of each unit of the block its text's number; texts, least ids that have them in this block, and each bucket's first one
        self.unit, self.texts, self.least = rank[unit], [distinct[i] for i in order.tolist()], least[order]
        self.edge = np.searchsorted(bucket[order], np.arange(buckets + 1))


def _units(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Kind 3: distinct unit texts of a block and bucket, with the least id of each."""

    def run(t: pa.Table) -> pa.Table:
        number = t.column("block")[0].as_py()
        parts = sorted(zip(t.column("bucket").to_pylist(), t.column("payload").to_pylist(), strict=True))
        c = Candidates(Block(*_texts(_read_ipc(parts[0][1])), length), parts[1:], length, buckets)
        out = []
        for k in np.flatnonzero(np.diff(c.edge)).tolist():
            a, b = int(c.edge[k]), int(c.edge[k + 1])
            ids = squeeze(c.least[a:b])
            out.append((3, number, k, pack(np.array([b - a, len(ids), *map(len, c.texts[a:b])], np.int64), ids + b"".join(c.texts[a:b]))))
        return pa.Table.from_batches([_rows(out)])

    return rows.groupBy("block").applyInArrow(run, ROWS)


def _answers(rows: DataFrame, length: int) -> DataFrame:
    """Kind 5: for the units of a block and bucket, in their order, a bit for each start: whether its string has a smaller id
    than the least of the unit in the block. (Which id doesn't matter: where it is smaller, all of the block's are greater.)"""

    def run(t: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        ids, units, edges = [], [], [0]
        for payload in t.column("payload").to_pylist():
            numbers, rest = unpack(payload)
            n, skip = int(numbers[0]), int(numbers[1])
            ends = skip + np.cumsum(numbers[2 : n + 2])
            units += [place.setdefault(rest[a:b], len(place)) for a, b in zip([skip, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            ids.append(unsqueeze(rest[:skip]).astype(np.int64))
            edges.append(len(units))
        unit = np.array(units, np.int64)
        least = np.full(len(place), NONE)
        np.minimum.at(least, unit, np.concatenate(ids))
        found, at = least_ids(list(place), least, length)
        n = np.diff(np.append(at, len(found)))
        out = []
        for i, (block, bucket) in enumerate(zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), strict=True)):
            own = unit[edges[i] : edges[i + 1]]
            smaller = found[flat_ranges(at[own], n[own])] < np.repeat(ids[i], n[own])
            out.append((5, block, bucket, zstandard.ZstdCompressor(level=3).compress(np.packbits(smaller).tobytes())))
        return pa.Table.from_batches([_rows(out)])

    return rows.groupBy("bucket").applyInArrow(run, ROWS)


def spans_to_cut(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the maximal runs that strings at these starts cover."""
    if not len(starts):
        return starts, starts
    first = np.append(True, starts[1:] - starts[:-1] > length)
    last = np.append(first[1:], True)
    return starts[first], starts[last] + length


RESULTS = [
    StructField("n_bytes", LongType()),
    StructField("n_removed", LongType()),
    StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType())]))),
    StructField("kept", BinaryType()),
]


def remove_repeats(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with ``text`` cut, and n_bytes, n_removed, spans (of bytes of
    the text as it was) and kept (the bytes that are left). ``length`` must be at least ``GRAM``."""
    docs = docs.drop(*(f.name for f in RESULTS))
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*docs.schema.fields, *RESULTS])
    blocks = written(_blocks(docs, length, buckets), "suffix-blocks", ("kind",))
    texts = blocks.where("kind = 0")
    shared = written(_shared_anchors(blocks.where("kind = 1"), hot), "suffix-anchors")
    answers = _answers(_units(texts.unionByName(shared), length, buckets), length)

    def cut(t: pa.Table) -> pa.Table:
        parts = sorted(zip(t.column("kind").to_pylist(), t.column("bucket").to_pylist(), t.column("payload").to_pylist(), strict=True))
        table = _read_ipc(parts[0][2])
        ids, raw = _texts(table)
        block = Block(ids, raw, length)
        c = Candidates(block, [(k, p) for kind, k, p in parts if kind == 2], length, buckets)
        size = np.array([len(x) for x in c.texts], np.int64) - length + 1
        at, bits = np.cumsum(size) - size, np.zeros(int(size.sum()), bool)
        for kind, k, p in parts:
            if kind == 5:
                a, b = int(c.edge[k]), int(c.edge[k + 1])
                n = int(size[a:b].sum())
                bits[at[a] : at[a] + n] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8), count=n).astype(bool)
        # a start is cut in documents with a greater id than this
        least = np.full(int(block.at[-1]) + 1, NONE)
        for lo in range(0, len(c.unit), 1 << 16):
            unit, start = c.unit[lo : lo + (1 << 16)], c.start[lo : lo + (1 << 16)]
            smaller = bits[flat_ranges(at[unit], size[unit])]
            least[flat_ranges(start, size[unit])] = np.where(smaller, -NONE, np.repeat(c.least[unit], size[unit]))
        n_bytes, spans, kept, cleaned = [], [], [], []
        for doc_id, text, which in zip(ids, raw, block.text_of, strict=True):
            a, b = int(block.at[which]), int(block.at[which + 1])
            hit = np.flatnonzero(least[a:b] < doc_id) if doc_id is not None else np.zeros(0, np.int64)
            first, end = spans_to_cut(hit, length)
            rest = text
            if len(hit):
                edges = [0, *np.stack([first, end], 1).ravel().tolist(), b - a]
                rest = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            n_bytes.append(b - a)
            spans.append([{"start": x, "length": y - x} for x, y in zip(first.tolist(), end.tolist(), strict=True)])
            kept.append(rest or b"")
            cleaned.append(rest if rest is None else rest.decode("utf-8", "ignore"))
        removed = [sum(s["length"] for s in x) for x in spans]
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        k = table.schema.get_field_index("text")
        table = table.set_column(k, "text", pa.array(cleaned, pa.string()))
        for name, values, kind in (("n_bytes", n_bytes, pa.int64()), ("n_removed", removed, pa.int64()), ("spans", spans, span), ("kept", kept, pa.binary())):
            table = table.append_column(name, pa.array(values, kind))
        return table

    return texts.unionByName(shared).unionByName(answers).groupBy("block").applyInArrow(cut, schema)


def repeat_digests(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``remove_repeats``' rows."""
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, bytes]], length: int) -> list[tuple[int | None, int, int, int, str]]:
    """The digests by the definition, for tests."""
    least: dict[bytes, int] = {}
    for doc_id, text in rows:
        if doc_id is not None:
            for i in range(len(text) - length + 1):
                s = text[i : i + length]
                least[s] = min(least.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if doc_id is not None and least[text[i : i + length]] < doc_id:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        runs = sum(1 for a, b in zip(b"\0" + bytes(gone), gone, strict=False) if b and not a)
        out.append((doc_id, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
