"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document's set is that of its distinct word n-grams. Sets whose sizes lie in one band differ, if their Jaccard
similarity is at least the threshold, in at most k elements, where k follows from the band's greatest size. The feature
domain is partitioned: by hash into ``n1`` groups of ``n2`` parts. If two sets differ in at most k elements, some group
holds at most ``k2`` of the differences, so some choice of n2 - k2 of its parts is equal in both sets; each choice of each
group is a signature, and similar sets of a band share one. A band also takes the somewhat smaller sets that a set of its
own may be similar to.

Parts can be empty, and what says only "empty" would be shared by many. So there are ``spare`` more groups than
needed: that many more of them must agree as well. A set with no more than ``spare`` groups in which a choice is empty
leaves such choices out, as one of the agreeing groups has none of them; other sets give them all.

Sets with one signature are a bucket; buckets with the same members count once. Members are compared inside their bucket,
before a pair exists, by size and by parity sketch: a bit for each hash value, flipped by each element that has it, so
sets that differ in h elements have at most h bits apart. What that can't rule out is emitted as a pair only if the two
aren't tied yet, by a verified link or by a pair of this pass, so a bucket emits a forest and never all of its pairs.
Emitted pairs are verified on the sets themselves, made anew from the texts. Then those buckets that gave pairs and still
have members of several components are compared again, without the pairs that failed and with more pairs allowed
between two components, until no pair is left. So every two sets that are similar end in one component.

A bucket of more than ``chunk`` members is dealt to parts of that many. Each pass compares all parts with ``chunk``
leaders (eight times as many each pass), drawn from the members outside the bucket's largest component; it's done when all
of those have been leaders.

Texts with the same set are one node: ``node`` is a 64-bit hash of the set, as its elements are 64-bit hashes of n-grams.

Defined results: without words, or with null text, a set is empty, n_shingles is 0 and the document is linked with
nothing; fewer words than n make one shingle. Rows with equal or null doc_id are documents of their own; component_id is
the least non-null doc_id of the component. Of other columns, whatever their names, nothing is read. A very long text is one
set like any other; its signatures, some 0.4 for each shingle, leave the task a chunk of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, gives_back, small_batches, written
from .components import settled
from .texthash import ODD, Words, chunks, mix, ngram_hashes

#: Bytes of texts whose words are hashed at once; the arrays of that take some 50 times as much.
AT_A_TIME = 1 << 20
#: Members of a bucket that one part compares with each other.
CHUNK = 2048
#: Words of sketches that are compared at once.
AT_ONCE = 1 << 19
#: First bits of signatures by which they are packed, and signatures that are packed or sorted at once.
HEAP_BITS = 12
PACKED = 1 << 20
#: Rows of packed signatures, or texts, that a task takes at once.
LOADS = 2048
#: Pairs, with both texts, that a task takes at once.
PAIRS = 256
#: Bits of the filter by which texts are picked before they are shuffled.
FILTER_BITS = 24


def shingle_sets(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct n-grams of words."""
    for lo, hi in chunks(texts, AT_A_TIME):
        w = Words(texts[lo:hi], lower=True)
        grams = ngram_hashes(w.hash, n)
        for i in range(hi - lo):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield ngram_hashes(np.append(w.hash[a:b], np.full(n - (b - a), b - a, np.uint64)), n)
            else:
                yield np.zeros(0, np.uint64)


@lru_cache(maxsize=None)
def band_edges(most: int) -> tuple[int, ...]:
    """Least sizes of the bands, three tenths larger each time, beyond ``most``."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, edges[-1] * 13 // 10))
    return tuple(edges)


def bands_of(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, greatest size in it) of each band in which a set of this size may meet a similar one."""
    edges = band_edges(1 << size.bit_length() + 1)
    own = int(np.searchsorted(edges, size, "right")) - 1
    found = [(own, edges[own + 1] - 1)]
    while den * size >= num * edges[own + 1]:
        own += 1
        found.append((own, edges[own + 1] - 1))
    return found


@lru_cache(maxsize=None)
def scheme(k: int) -> tuple[int, int, int, np.ndarray]:
    """Groups, parts of a group, spare groups, and the choices of parts, for k differences."""
    if k <= 5:
        k2, n2, needed, spare = k, (1, 5, 5, 6, 7, 8)[k], 1, 0
    elif k <= 11:
        k2, n2, needed, spare = 3, 6, k // 4 + 1, 0
    else:
        k2, n2, needed = 1, 2, k // 2 + 1
        spare = 3 + needed // 12
    return needed + spare, n2, spare, np.array(list(combinations(range(n2), n2 - k2)))


def all_signatures(sets: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The signatures of non-empty sets of hashes, band by band, for all sets of a band at once: numbers of sets, and their signatures."""
    own_bands = {}
    for i, s in enumerate(sets):
        for band in bands_of(len(s), num, den):
            own_bands.setdefault(band, []).append(i)
    for (band, most), inside in own_bands.items():
        n1, n2, spare, choices = scheme((den - num) * 2 * most // (den + num))
        parts = n1 * n2
        for lo in range(0, len(inside), step := max(1, AT_ONCE // (parts + most))):
            own = np.array(inside[lo : lo + step])
            sizes = np.array([len(sets[i]) for i in own])
            flat = np.concatenate([sets[i] for i in own])
            at = ((mix(flat + np.uint64(band)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64) + np.repeat(np.arange(len(own)) * parts, sizes)
            counts = np.bincount(at, minlength=parts * len(own)).reshape(len(own), n1, n2)
            h = mix(flat * ODD)
            # sums of halves are exact as doubles
            low, high = (np.bincount(at, weights=x.astype(np.float64), minlength=parts * len(own)).astype(np.uint64) for x in (h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)))
            sums = (low + (high << np.uint64(32))).reshape(len(own), n1, n2)
            h = np.broadcast_to(np.full((n1, 1), np.uint64(band)) + np.arange(n1, dtype=np.uint64)[:, None] * ODD, (len(own), n1, len(choices)))
            for j in range(choices.shape[1]):
                h = mix(h * ODD + sums[:, :, choices[:, j]] + choices[:, j].astype(np.uint64))
            empty = counts[:, :, choices].sum(axis=3) == 0
            keep = ~empty | (empty.any(axis=2).sum(axis=1) > spare)[:, None, None]
            yield np.repeat(own, keep.sum(axis=(1, 2))), h[keep]


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signatures of one set."""
    return np.concatenate([sig for _, sig in all_signatures([s], num, den)])


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set, the same for the same elements."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    first = np.cumsum(sizes) - sizes
    sums = []
    for x in (mix(flat), mix(flat ^ ODD)):
        total = np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))
        sums.append(total[first + sizes] - total[first])
    a, b, c = (mix(x) for x in (sizes.astype(np.uint64), *sums))
    return mix(mix(a * ODD + b) * ODD + c).view(np.int64)


def heap_of(sig: np.ndarray) -> np.ndarray:
    """The first bits of signatures."""
    return (sig.view(np.uint64) >> np.uint64(64 - HEAP_BITS)).astype(np.uint16)


def sketch(s: np.ndarray) -> bytes:
    """Parity sketch: 1.5 to 3 bits for each element, 64 at least, a power of two."""
    bits = 64
    while bits < 1.5 * len(s):
        bits *= 2
    at = (mix(s + ODD) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits apart of sketches (rows of words of the same length): no more than the elements that one of two sets has alone."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """A sketch folded to fewer words: hash values that agree in the lower bits share one."""
    return np.bitwise_xor.reduce(words.reshape(-1, to), axis=0)


DOC = "struct<doc_id:bigint,n:int,picked:bigint,sketch:binary>"
DOC_TYPE = pa.struct([("doc_id", pa.int64()), ("n", pa.int32()), ("picked", pa.int64()), ("sketch", pa.binary())])


def _rows(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """A row with ``doc`` for each document, and rows with a ``load`` of signatures and their nodes, packed by the signatures' first bits (``heap``)."""

    def packed(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        heap = heap_of(sig)
        order = np.argsort(heap, kind="stable")
        count = np.bincount(heap, minlength=1 << HEAP_BITS)
        own = np.flatnonzero(count)
        ends = np.append(0, np.cumsum(count[own]) * 16).astype(np.int32)
        data = np.stack([sig[order], node[order]], axis=1)
        load = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), load, pa.nulls(len(own), pa.int64()), pa.nulls(len(own), DOC_TYPE)], names=["heap", "load", "node", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in chunks(texts, AT_A_TIME):
                sets = list(shingle_sets(texts[lo:hi], n))
                nodes = nodes_of(sets)
                _, first = np.unique(nodes, return_index=True)
                first = [i for i in first if len(sets[i])]
                picked = batch.column(1).slice(lo, hi - lo)
                doc = pa.StructArray.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int32()), picked, pa.array([sketch(s) for s in sets], pa.binary())], names=["doc_id", "n", "picked", "sketch"])
                heap = heap_of(mix(np.asarray(picked).view(np.uint64)).view(np.int64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(heap), pa.nulls(hi - lo, pa.binary()), pa.array(nodes), doc], names=["heap", "load", "node", "doc"])
                for own, sig in all_signatures([sets[i] for i in first], num, den):
                    held.append((sig.view(np.int64), nodes[first][own]))
                    count += len(sig)
                if count >= PACKED:
                    yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, count = [], 0
        if count:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return _texts(docs).mapInArrow(gives_back(run), f"heap int, load binary, node long, doc {DOC}")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, picked (a hash of the row by which it is found again) and the text's bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("picked"), F.col("text").cast("binary").alias("raw"))


def _buckets(rows: DataFrame, chunk: int) -> DataFrame:
    """Documents as they are (kind 0); signatures, whose heaps must come in order, as buckets of several nodes (kind 1); ``whole`` if one row is all of a
    bucket. A heap is held, without what signatures of more than ``chunk`` nodes have, which leaves it in pieces."""
    names = ["kind", "bucket", "whole", "members", "node", "doc"]

    def give(sig: np.ndarray, node: np.ndarray, long: np.ndarray, last: bool) -> tuple[pa.RecordBatch | None, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets that go out, and the signatures, nodes and long signatures that stay: at first those of long buckets go, at ``last`` all that have several nodes."""
        order = np.argsort(sig)
        sig, node = sig[order], node[order]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(start, len(sig)))
        several = np.repeat((size > 1) | np.isin(sig[start], long), size)
        alone = sig[~several], node[~several]
        sig, node = sig[several], node[several]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))[: len(sig)]
        sig, node = sig[new], node[new]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))[: len(sig)]
        size = np.diff(np.append(start, len(sig)))
        known = np.isin(sig[start], long)
        out = (size > 1) | known if last else size > chunk
        whole = ~known & (size <= chunk)
        took = np.repeat(out, size)
        stay = [np.append(x, y[~took]) for x, y in zip(alone, (sig, node), strict=True)]
        long = np.union1d(long, sig[start][out & ~whole])
        if not out.any():
            return None, *stay, long
        members = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[out])), pa.int32()), pa.array(node[took]))
        m = int(out.sum())
        batch = pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(sig[start][out]), pa.array(whole[out]), members, pa.nulls(m, pa.int64()), pa.nulls(m, DOC_TYPE)], names=names)
        return batch, *stay, long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        loads, long, count, now, limit = [], none, 0, None, PACKED
        for batch in batches:
            is_doc = batch.column(3).is_valid()
            docs = batch.filter(is_doc)
            if docs.num_rows:
                m = docs.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.list_(pa.int64())), docs.column(2), docs.column(3)], names=names)
            packed = batch.filter(pc.invert(is_doc))
            for heap, load in zip(packed.column(0).to_numpy(), packed.column(1)):
                if heap != now or count >= limit:
                    if count:
                        both = np.concatenate(loads)
                        out, sig, node, long = give(both[:, 0], both[:, 1], long, heap != now)
                        loads, count = [np.stack([sig, node], axis=1)], len(sig)
                        limit = max(PACKED, 2 * count)
                        if out is not None:
                            yield out
                    if heap != now:
                        loads, long, count, now, limit = [], none, 0, heap, PACKED
                # a copy, as the batch is larger than this
                loads.append(np.frombuffer(load.as_buffer(), np.int64).reshape(-1, 2).copy())
                count += len(loads[-1])
        if count:
            both = np.concatenate(loads)
            out = give(both[:, 0], both[:, 1], long, True)[0]
            if out is not None:
                yield out

    return rows.mapInArrow(gives_back(run), f"kind int, bucket long, whole boolean, members array<long>, node long, doc {DOC}")


def _members(buckets: DataFrame) -> DataFrame:
    """(bucket, node); of buckets with the same members one stands for all."""
    whole = buckets.where("whole").groupBy("members").agg(F.min("bucket").alias("bucket"))
    found = whole.select("bucket", "members").unionByName(buckets.where("not whole").select("bucket", "members"))
    return found.select("bucket", F.explode("members").alias("node"))


def _dealt(members: DataFrame, comp: DataFrame | None, chunk: int, most: int) -> DataFrame:
    """(bucket, part, node, comp, lead, done) of buckets with several components. Small ones are one part of leaders. Of others, each part
    gets the leaders of the bucket; ``done`` if all outside its largest component are among those."""
    if comp is None:
        left = members.withColumn("comp", F.col("node"))
    else:
        left = members.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
    sums = left.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    sums = sums.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    sums = sums.select("bucket", F.ceil(F.col("size") / chunk).cast("int").alias("parts"), F.col("top.comp").alias("main"), F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("top.n")) / most)).cast("long").alias("of"))
    left = left.join(sums, "bucket")
    small = F.col("parts") == 1
    lead = small | ((F.col("comp") != F.col("main")) & (F.pmod(F.xxhash64("node", F.lit(most)), F.col("of")) == 0))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    to = F.when(lead, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    return left.select("bucket", "node", "comp", lead.alias("lead"), (small | (F.col("of") == 1)).alias("done"), F.explode(to).alias("part"))


def _compared(dealt: DataFrame, num: int, den: int, allowed: int) -> DataFrame:
    """(bucket, a, b): pairs of leaders and members of other components, a > b, that sketches can't rule out; no more than
    ``allowed`` of two that are tied by them. A bucket that isn't ``done`` has a row without a pair besides."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["bucket", "part", "node", "comp", "lead", "n", "sketch", "bad", "done"]
    dealt = dealt.select(*columns).repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part")

    def similar(n: np.ndarray, m: np.ndarray, bits: np.ndarray) -> np.ndarray:
        both = n + m
        return (both - bits) * den >= num * (both + bits)

    def two(rows: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
        """Of the buckets of two members that begin at these rows, those whose members may be similar."""
        n, sketches = rows.column(5).to_numpy(), rows.column(6)
        at = np.frombuffer(sketches.buffers()[1], np.int32, len(sketches) + 1, sketches.offset * 4).astype(np.int64)
        flat, size = np.frombuffer(sketches.buffers()[2], np.uint64), np.diff(at) // 8
        x, y = np.where(size[first] <= size[first + 1], first, first + 1), np.where(size[first] <= size[first + 1], first + 1, first)
        out = np.zeros(len(first), bool)
        shape = size[y] << 20 | size[x]
        for s in np.unique(shape):
            own = np.flatnonzero(shape == s)
            small, large = int(s & (1 << 20) - 1), int(s >> 20)
            for lo in range(0, len(own), step := max(1, AT_ONCE // large)):
                k = own[lo : lo + step]
                p = flat[(at[x[k]] // 8)[:, None] + np.arange(small)]
                q = flat[(at[y[k]] // 8)[:, None] + np.arange(large)].reshape(len(k), -1, small)
                out[k] = similar(n[x[k]], n[y[k]], apart(p, np.bitwise_xor.reduce(q, axis=1)))
        return out

    def compare(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        node, comp, lead, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5))
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(6)]
        least = min(map(len, words))
        bits = np.stack([folded(w, least) for w in words])
        bad = {}
        if rows.column(7).null_count < len(node):
            for i, others in enumerate(rows.column(7).to_pylist()):
                for j in np.flatnonzero(np.isin(node, others)) if others else ():
                    bad.setdefault(i, []).append(j)
                    bad.setdefault(j, []).append(i)
        root, tied, a, b = comp.copy(), {}, [], []
        leaders = np.flatnonzero(lead)
        later = np.where(lead, np.arange(len(node)), len(node))  # a pair of leaders counts once
        for lo in range(0, len(leaders), step := max(1, AT_ONCE // (len(node) * least))):
            own = leaders[lo : lo + step]
            may = similar(n[own, None], n[None], apart(bits[own, None], bits[None])) & (comp[own, None] != comp[None]) & (later[None] > own[:, None])
            for r in np.flatnonzero(may.any(axis=1)):
                i = own[r]
                x = np.flatnonzero(may[r] & (root != root[i]))
                for j in np.setdiff1d(x, bad[i]) if i in bad else x:
                    if root[i] != root[j]:
                        a.append(i)
                        b.append(j)
                        key = (min(root[i], root[j]), max(root[i], root[j]))
                        tied[key] = tied.get(key, 0) + 1
                        if tied[key] >= allowed:
                            root[root == root[j]] = root[i]
        x, y = node[a], node[b]
        return np.maximum(x, y), np.minimum(x, y)

    def give(rows: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        out, bucket, done = [], rows.column(0).to_numpy(), rows.column(8).to_numpy(zero_copy_only=False)
        open_ = pa.array(bucket[bounds[:-1]][~done[bounds[:-1]]])
        node, comp, lead = (rows.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        plain = np.diff(bounds) == 2  # most buckets are of two members, both of which lead
        plain[plain] = rows.column(7).null_count == rows.num_rows and lead[bounds[:-1][plain]] & lead[bounds[:-1][plain] + 1]
        first = bounds[:-1][plain]
        first = first[comp[first] != comp[first + 1]]
        first = first[two(rows, first)]
        if len(first):
            out.append((bucket[first], np.maximum(node[first], node[first + 1]), np.minimum(node[first], node[first + 1])))
        rest = np.flatnonzero(~plain)
        for lo, hi in zip(bounds[rest], bounds[rest + 1], strict=True):
            a, b = compare(rows.slice(lo, hi - lo))
            if len(a):
                out.append((np.full(len(a), bucket[lo]), a, b))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["bucket", "a", "b"])
        if len(open_):
            yield pa.RecordBatch.from_arrays([open_, *[pa.nulls(len(open_), pa.int64())] * 2], names=["bucket", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            bucket, part = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])))
            yield from give(rows, starts)
            held = rows.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from give(held, np.array([0, held.num_rows]))

    return dealt.mapInArrow(gives_back(run), "bucket long, a long, b long")


def _bits(picked: Column) -> tuple[Column, Column]:
    """Word and bit of the filter for a hash."""
    at = F.pmod(picked, F.lit(1 << FILTER_BITS))
    return F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, raw) for the wanted (node, picked). A filter of fixed size (2**18 words of 64 bits) keeps most other texts out of the shuffle."""
    word, bit = _bits(F.col("picked"))
    on = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("on"))
    found = _texts(docs).select("picked", "raw", word.alias("word"), bit.alias("bit")).join(F.broadcast(on), "word").where(F.expr("on & shiftleft(1L, bit)") != 0)
    found = found.groupBy("picked").agg(F.first("raw").alias("raw"))
    return wanted.join(found, "picked").select("node", "raw")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b, good): whether the sets of two nodes are similar, on sets made anew from the texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = written(_texts_of(docs, nodes.join(ends, "node").select("node", "picked")), "texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("raw").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("raw").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            xs, ys, good = batch.column(2), batch.column(3), []
            size = xs.nbytes // max(1, batch.num_rows) + 1
            step = max(1, AT_A_TIME // size)
            for lo in range(0, batch.num_rows, step):
                for y, b, x in zip(ys.slice(lo, step), batch.column(1).slice(lo, step).to_pylist(), shingle_sets(xs.slice(lo, step).to_pylist(), n)):
                    if b != last:
                        last, own = b, next(shingle_sets([y.as_py()], n))
                    common = len(np.intersect1d(x, own, assume_unique=True))
                    good.append(common * den >= num * (len(x) + len(own) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    with small_batches(docs.sparkSession, PAIRS):
        checked = written(both.select("a", "b", "x", "y").mapInArrow(gives_back(run), "a long, b long, good boolean"), "checked")
    drop_written(texts)
    return checked


def linked(docs: DataFrame, nodes: DataFrame, members: DataFrame, n: int, num: int, den: int, chunk: int = CHUNK) -> DataFrame:
    """(node, component), without the components' own least nodes, of nodes (node, n, picked, sketch) that meet in ``members``,
    a written table that is deleted."""
    comp = failed = None
    most, allowed = chunk, 1
    while True:
        dealt = _dealt(members, comp, chunk, most)
        rows = dealt.join(nodes.select("node", "n", "sketch"), "node")
        if failed is None:
            rows = rows.withColumn("bad", F.lit(None).cast("array<long>"))
        else:
            rows = rows.join(failed.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("bad")), "node", "left")
        found = written(_compared(rows, num, den, allowed), "pairs")
        again = written(members.join(found.select("bucket").distinct(), "bucket", "left_semi"), "members")
        pairs = written(found.where("a is not null").select("a", "b").distinct(), "distinct-pairs")
        checked = _verified(docs, nodes, pairs, n, num, den)
        good, bad = checked.where("good").select("a", "b"), checked.where("not good").select("a", "b")
        ties = settled(good if comp is None else good.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        drop_written(found, pairs, members)
        comp, members = ties.select(F.col("a").alias("node"), F.col("b").alias("component")), again
        failed = bad if failed is None else failed.unionByName(bad)
        if members.isEmpty():
            return comp
        most, allowed = most * 8, allowed * 32


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles and component_id for each document (columns doc_id, text); documents link when
    den * intersection >= num * union."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _rows(docs, n, num, den).repartition(parts, "heap").sortWithinPartitions("heap")
    with small_batches(docs.sparkSession, LOADS, "16m"):
        both = written(_buckets(rows, chunk), "signatures", ("kind",))
    meta = both.where("kind = 0").select("node", "doc.*")
    members = written(_members(both.where("kind = 1").select("bucket", "whole", "members")), "members")
    nodes = meta.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("picked", "n", "sketch")).alias("doc")).select("node", "doc.*")
    comp = linked(docs, written(nodes, "nodes"), members, n, num, den, chunk)

    own = meta.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    own = own.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = own.groupBy("component").agg(F.min("least").alias("component_id"))
    named = own.join(names, "component").select("node", "component_id")
    linked_docs = meta.where("n > 0").join(named, "node").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return linked_docs.unionByName(meta.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
