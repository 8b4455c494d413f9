"""Benchmark decontamination: every passage is a BM25 query on an inverted index of the test items.

The index: item texts are cut into words (ASCII letters in lower case; ASCII but letters and digits separates
words). A posting is (term, item, impact); impacts are BM25 weights over the items divided by the item's score of its
own text, so 1.0 means "as good as the item itself" and one threshold fits all items. Items are numbered by
their rarest term, so that blocks of ``BLOCK_ITEMS`` hold items alike, and each term keeps its greatest
impact over all items and in each block.

Block-max WAND, for all passages of a batch at once: a passage whose terms' greatest impacts together stay under the
threshold is left (the pivot test); of the rest, the blocks whose block maxima together reach it are opened, and
their postings scored in full; postings of blocks that stay closed are never read. Everything above the threshold is retrieved; there is no limit.

Passages are overlapping windows, stepping by half of their words. Items are indexed by bands of lengths (up to 32 words, 64, 128, ...), and meet
passages of twice their band's words, so that each item that a document holds lies whole in one of them, and what is found of an item
doesn't depend on other items. A retrieved pair is verified on the passage's words: the item's
question is its sentences but the last, its answer is the last one (of a single sentence: the first two thirds and the
rest). A part's overlap is the greater of two shares: of its distinct ``gram``-word shingles that are in the passage (of a part
with fewer words, the whole part), and of its words that an alignment with the best run of the passage's words leaves
unedited. Both parts must reach ``overlap``, or the whole item must lie in the passage with one word edited at most (and so
with a share of ``overlap`` too, which one edit of fewer than five words hasn't).

Numbers of items that have a term, of all items, and the mean length are those of the whole benchmark, whatever the shards.
The index has a proven bound: items are read in shards of ``SHARD_BYTES`` of text at most (a longer item is a
shard of its own). ``PASS`` of them are broadcast together, as texts; each Python worker builds their indexes, and all passages meet
them in one pass over the documents.

Defined results: an empty table of documents gives no rows, one of items finds nothing; a very long text is searched whole, passage by passage; columns of documents
that have names of the result aren't read; a null or empty text holds nothing; items without words are left out, a null item_id is an item like any other;
items with equal id and text count once, different texts under one id each count. Rows with
equal or null doc_id are judged each; a pair that several passages of a document have is given once, with its best passage.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back, written
from .texthash import Words, chunks, flat_ranges, ngram_hashes

K1, B = 1.2, 0.75
BLOCK_ITEMS = 32
SHARD_BYTES = 512 << 10
#: Shards that meet the documents in one pass.
PASS = 8
#: ASCII but letters and digits separates words.
SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
RESULT = "doc_id long, row long, item_id long, item int, score double, question_overlap double, answer_overlap double"


def hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one more than texts)."""
    w = Words([(t or b"").translate(SEPARATE) for t in texts], lower=True)
    return w.hash, w.first


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingles; of fewer words, the whole sequence as one."""
    return np.unique(ngram_hashes(h, min(n, len(h)))) if len(h) else np.zeros(0, np.uint64)


def halves(text: str) -> tuple[str, str]:
    """Question and answer of an item's text."""
    parts = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text)]
    if parts:
        return text[: parts[-1]], text[parts[-1] :]
    words = [m.start() for m in re.finditer(r"\S+", text)]
    at = words[-(-2 * len(words) // 3)] if len(words) > 2 else len(text)
    return text[:at], text[at:]


class Index:
    """Inverted index of one shard of items (id, text)."""

    def __init__(self, items: list[tuple[int | None, str]], gram: int, whole: tuple[int, float, dict[int, int]] | None = None, stride: int = 32):
        """``whole``: items, mean length and, of each term here, the items that have it in the whole benchmark, if these are but a part. ``stride``:
        words from passage to passage, which are twice as long; no item is longer than that."""
        self.stride = stride
        h, first = hashes([t.encode() for _, t in items])
        bags = [Counter(h[a:b].tolist()) for a, b in zip(first, first[1:], strict=False)]
        df = {t: whole[2][t] for bag in bags for t in bag} if whole else Counter(t for bag in bags for t in bag)
        order = sorted((i for i in range(len(items)) if bags[i]), key=lambda i: (min((df[t], t) for t in bags[i]), items[i][0] is None, items[i][0] or 0, items[i][1]))
        self.ids = [items[i][0] for i in order]
        self.texts = [items[i][1] for i in order]
        bags = [bags[i] for i in order]
        n = len(order)
        length = np.array([b.total() for b in bags], np.int64)
        total, mean = whole[:2] if whole else (n, length.mean() if n else 1.0)
        idf = {t: np.log(1 + (total - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        self.terms = np.array(sorted(df), np.uint64)
        place = {int(t): k for k, t in enumerate(self.terms.tolist())}
        term, item, impact = [], [], []
        for i, bag in enumerate(bags):
            # a query counts each distinct term once
            w = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * length[i] / mean)) for t, c in bag.items()}
            whole = sum(w.values())
            for t, x in w.items():
                term.append(place[t])
                item.append(i)
                impact.append(x / whole)
        by = np.lexsort((item, term)) if term else np.zeros(0, np.int64)
        self.item = np.array(item, np.int64)[by]
        self.impact = np.array(impact, np.float64)[by]
        self.begin = np.searchsorted(np.array(term, np.int64)[by], np.arange(len(self.terms) + 1))
        #: greatest impact of each term, over all items and by block
        self.blocks = -(-n // BLOCK_ITEMS)
        self.block_max = np.zeros((len(self.terms), max(1, self.blocks)))
        np.maximum.at(self.block_max, (np.array(term, np.int64)[by], self.item // BLOCK_ITEMS), self.impact)
        self.most = self.block_max.max(axis=1) if len(self.terms) else np.zeros(0)
        #: where the postings of each term in each block begin, of those that have any
        segment = np.array(term, np.int64)[by] * max(1, self.blocks) + self.item // BLOCK_ITEMS
        self.segment, self.segment_begin = np.unique(segment, return_index=True)
        self.segment_size = np.diff(np.append(self.segment_begin, len(segment)))
        qa = [halves(t) for t in self.texts]
        self.parts = [[hashes([p.encode()])[0] for p in pair] for pair in qa]
        self.shingles = [[shingles(x[0], gram) for x in (hashes([p.encode()]) for p in pair)] for pair in qa]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of words, -1 for words that no item has."""
        if not len(self.terms):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[k] == h, k, -1)


def passages(first: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and text of each passage; the last of a text ends with it."""
    n = np.diff(first)
    times = np.where(n > 0, 1 + np.maximum(0, -(-(n - size) // stride)), 0)
    text = np.repeat(np.arange(len(n)), times)
    k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    start = first[text] + np.minimum(k * stride, np.maximum(0, n[text] - size))
    return start, np.minimum(start + size, first[text + 1]), text


def search(index: Index, h: np.ndarray, start: np.ndarray, end: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all pairs that reach the threshold."""
    none = np.zeros(0, np.int64)
    term = index.lookup(h)
    # pivot test, first with repeated words counted again: that bound is looser, and needs no sorting
    sums = np.append(0.0, np.cumsum(np.where(term >= 0, index.most[np.maximum(term, 0)] if len(index.most) else 0.0, 0.0)))
    slack = 1e-9 * max(1, len(h))
    alive = np.flatnonzero(sums[end] - sums[start] >= threshold - slack)
    if not len(alive):
        return none, none, np.zeros(0)
    # distinct terms of the passages that are left
    n = end[alive] - start[alive]
    t, p = term[flat_ranges(start[alive], n)], np.repeat(np.arange(len(alive)), n)
    pair = np.unique(p[t >= 0] * len(index.terms) + t[t >= 0])
    p, t = pair // len(index.terms), pair % len(index.terms)
    keep = np.flatnonzero(np.bincount(p, index.most[t], len(alive)) >= threshold - 1e-9)
    renumber = np.full(len(alive), -1)
    renumber[keep] = np.arange(len(keep))
    t, p = t[renumber[p] >= 0], renumber[p][renumber[p] >= 0]
    if not len(keep):
        return none, none, np.zeros(0)
    # block maxima: blocks that can reach the threshold
    bound = np.add.reduceat(index.block_max[t], np.flatnonzero(np.append(True, p[1:] != p[:-1])), axis=0)
    opened = bound >= threshold - 1e-9
    # postings of those passages' terms in opened blocks; those of other blocks are skipped
    count = opened.sum(axis=1)
    block = np.nonzero(opened)[1]
    first = np.cumsum(count) - count
    wanted = np.repeat(t, count[p]) * max(1, index.blocks) + block[flat_ranges(first[p], count[p])]
    p = np.repeat(p, count[p])
    k = np.minimum(np.searchsorted(index.segment, wanted), len(index.segment) - 1)
    there = index.segment[k] == wanted
    p, k = p[there], k[there]
    at = flat_ranges(index.segment_begin[k], index.segment_size[k])
    p = np.repeat(p, index.segment_size[k])
    pair, back = np.unique(p * len(index.ids) + index.item[at], return_inverse=True)
    total = np.bincount(back, index.impact[at], len(pair))
    hit = total >= threshold - 1e-9
    return alive[keep[pair[hit] // len(index.ids)]], pair[hit] % len(index.ids), total[hit]


def fewest_edits(part: np.ndarray, words: np.ndarray) -> int:
    """Words to put in, take out or replace, at least, to make ``part`` of a run of ``words``."""
    place = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for k, word in enumerate(part, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (words != word))
        row = np.minimum.accumulate(np.append(k, step) - place) + place
    return int(row.min())


def distinct_items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.where(F.length("text") > 0).distinct()


def term_counts(items: DataFrame) -> DataFrame:
    """term, n (items that have it), words (that it has in them all); term is null in a row for the items as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = hashes([(t or "").encode() for t in batch.column(0).to_pylist()])
            bags = [np.unique(h[a:b], return_counts=True) for a, b in zip(first, first[1:], strict=False) if b > a]
            term = np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in bags)]).view(np.int64)
            count = np.concatenate([np.zeros(0, np.int64), *(c for _, c in bags)])
            yield pa.RecordBatch.from_arrays([pa.array([*term.tolist(), *[None] * len(bags)], pa.int64()), pa.array([*count.tolist(), *(int(c.sum()) for _, c in bags)], pa.int64())], names=["term", "words"])

    return items.select("text").mapInArrow(gives_back(run), "term long, words long").groupBy("term").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


Numbers = tuple[int, float, dict[int, int]] | None
_BUILT: dict[str, list[Index]] = {}


def passes(benchmark: DataFrame, gram: int) -> Iterator[Broadcast]:
    """What one pass over the documents needs: a key, ``PASS`` shards of items at most, each with the whole benchmark's numbers."""
    items = distinct_items(benchmark)
    spark = items.sparkSession
    whole = (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= SHARD_BYTES  # one shard is the whole
    counts, n, mean = None, 0, 1.0
    if not whole:
        counts = written(term_counts(items), "benchmark-terms")
        all_items = counts.where("term IS NULL").first()
        n, mean = (all_items.n, all_items.words / all_items.n) if all_items else (0, 1.0)

    def numbers(shard: list[tuple[int | None, str]]) -> Numbers:
        if whole:
            return None
        own = np.unique(hashes([t.encode() for _, t in shard])[0]).view(np.int64)
        # a shard's terms: no more than half its bytes
        terms = spark.createDataFrame([(t,) for t in own.tolist()], "term long")
        return n, mean, {r.term % (1 << 64): r.n for r in counts.join(F.broadcast(terms), "term").collect()}

    group: list[tuple[list, Numbers]] = []
    for shard in shards(benchmark):
        group.append((shard, numbers(shard)))
        if len(group) == PASS:
            yield spark.sparkContext.broadcast((uuid.uuid4().hex, gram, group))
            group = []
    if group:
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, gram, group))


def built(shared: Broadcast) -> list[Index]:
    """The indexes of a pass; built once in each Python worker."""
    key, gram, group = shared.value
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [index for shard, numbers in group for index in by_length(shard, gram, numbers)]
    return _BUILT[key]


def by_length(items: list[tuple[int | None, str]], gram: int, whole: Numbers = None) -> list[Index]:
    """An index for each band of lengths (up to 32 words, 64, 128, ...), with the numbers of all items. Passages are as long as an item's own band
    asks for, so what is found of it doesn't depend on which others there are."""
    h, first = hashes([t.encode() for _, t in items])
    sizes = np.diff(first)
    if whole is None:
        held = Counter(t for a, b in zip(first, first[1:], strict=False) for t in set(h[a:b].tolist()))
        n = int((sizes > 0).sum())
        whole = (n, sizes.sum() / n if n else 1.0, held)
    bands: dict[int, list] = {}
    for item, size in zip(items, sizes.tolist(), strict=True):
        bands.setdefault(max(32, 1 << max(0, size - 1).bit_length()), []).append(item)
    return [Index(own, gram, whole, stride) for stride, own in sorted(bands.items())]


def shards(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in shards of ``SHARD_BYTES`` at most, read one after the other."""
    items = distinct_items(benchmark)
    shard, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if shard and size + len(r.text) > SHARD_BYTES:
            yield shard
            shard, size = [], 0
        shard.append((r.item_id, r.text))
        size += len(r.text)
    if shard:
        yield shard


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.8, gram: int = 5) -> DataFrame:
    """doc_id, row (a number of the document row), item_id, score, question_overlap and answer_overlap of each pair of a
    document and a test item that it holds."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = None
    for shared in passes(benchmark, gram):
        part = _with_shards(texts, shared, threshold, overlap, gram)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], RESULT)
    return found.drop("item")


def _with_shards(texts: DataFrame, shared: Broadcast, threshold: float, overlap: float, gram: int) -> DataFrame:
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for (lo, hi), index in product(chunks(raw, 2 << 20), built(shared)):
                best = found_in(index, raw[lo:hi], threshold, overlap, gram, index.stride)
                out = [(ids[lo + d], row + lo + d, index.ids[i], i, *x) for (d, i), x in sorted(best.items())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            row += batch.num_rows

    return texts.mapInArrow(gives_back(run), RESULT)


def found_in(index: Index, texts: list[bytes | None], threshold: float, overlap: float, gram: int, stride: int) -> dict[tuple[int, int], tuple[float, float, float]]:
    """Score and overlaps of each verified (text, item)."""
    h, first = hashes(texts)
    start, end, text = passages(first, 2 * stride, stride)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    had, grams = -1, None
    for p, i, s in zip(*(x.tolist() for x in search(index, h, start, end, threshold)), strict=True):
        if p != had:
            words = h[start[p] : end[p]]
            had, grams = p, {gram: shingles(words, gram)}
        shares = []
        for part, own in zip(index.shingles[i], index.parts[i], strict=True):
            n = gram
            if len(part) == 1:  # perhaps a part with fewer words
                n = index_words(index, i, part, gram)
            if n not in grams:
                grams[n] = shingles(words, n)
            share = float(np.isin(part, grams[n]).mean()) if len(part) else 1.0
            if share < overlap:
                share = max(share, 1 - fewest_edits(own, words) / len(own))
            shares.append(share)
        held = min(shares) >= overlap
        if not held:
            item = np.concatenate(index.parts[i])
            held = 1 - 1 / len(item) >= overlap and fewest_edits(item, words) <= 1
        if held:
            key = (int(text[p]), i)
            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (s, *shares))
    return best


def index_words(index: Index, item: int, part: np.ndarray, gram: int) -> int:
    """Words of the shingle that a part with a single one has."""
    for text in halves(index.texts[item]):
        h, _ = hashes([text.encode()])
        if len(h) and np.array_equal(shingles(h, gram), part):
            return min(gram, len(h))
    return gram


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.8, gram: int = 5) -> DataFrame:
    """``docs`` without the rows that hold a test item; a filter, so rows aren't shuffled."""
    for shared in passes(benchmark, gram):
        docs = _without_shards(docs, shared, threshold, overlap, gram)
    return docs


def _without_shards(docs: DataFrame, shared: Broadcast, threshold: float, overlap: float, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            keep = np.ones(len(raw), bool)
            for (lo, hi), index in product(chunks(raw, 2 << 20), built(shared)):
                keep[[lo + d for d, _ in found_in(index, raw[lo:hi], threshold, overlap, gram, index.stride)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(gives_back(run), docs.schema)
