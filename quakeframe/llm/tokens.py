"""Content-addressed store of token ids.

Documents are encoded whole with the tokenizers library, and an end id is appended. A rolling hash
over the last ids cuts each document's ids into chunks (between ``MIN`` and ``MAX`` ids, some 512 on
average), so equal passages give equal chunks wherever they stand. The store has three tables:

* chunks: SHA-256 and ids (little-endian, 2 bytes an id if the vocabulary allows, else 4), once each;
* recipes: in ascending doc_id order, cut in segments, a document's number of ids, the hashes of its
  chunks and the root of their Merkle tree;
* manifest: for each segment the first and last doc_id, documents, ids, ids of all segments before,
  and the root over its recipe rows (place, doc_id, start, number of ids and document root of each).

Reading first makes each segment's manifest row anew from its recipes and compares all of them with the manifest; then it
joins recipes with chunks, puts ids together in order, and hashes everything again. A document or segment that
is missing, or whose root or numbers differ, raises an error.

As the library's normaliser and splitter never look across white space, words are encoded once for each
Python worker and looked up; texts that hold a special token's name, or marks that join with letters, are encoded whole. A test compares this with the library's encoding of
whole texts.

Defined results: a null or empty text is the end id alone; a null doc_id comes first; rows with
equal doc_id are kept, in an order that a run keeps to; an empty table gives empty tables. A very long text is encoded
by itself and cut in chunks like any other. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .texthash import ODD, chunks, flat_ranges, mix

MIN, MASK, MAX, LOOK = 128, np.uint64(511), 2048, 8
#: Words that a Python worker remembers the ids of.
REMEMBER = 600_000
#: Words of letters that are encoded in one text.
JOINED = 512
#: Marks that letters of ASCII join with when texts are normalised.
MARKS = "[\u0300-\u036f]"
_WORKER: list = []


class Encoder:
    """The library's encoding of words, each word once for each Python worker as long as it is remembered."""

    def __init__(self, key: str, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.key, self.tokenizer = key, Tokenizer.from_str(text)
        model = json.loads(text)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        #: ids that end a piece, if the model marks them
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
        if suffix:
            self.last[[v for k, v in model["vocab"].items() if k.endswith(suffix)]] = True
        self.special = [t["content"] for t in json.loads(text).get("added_tokens", [])]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Encodes new words. Words of letters alone are one piece each, so many are encoded in one text and told apart
        by the ids that end a piece; if those aren't as many as the words, and for all other words, each is encoded by itself."""
        plain, other = [], []
        for w in words:
            (plain if w.isalpha() else other).append(w)
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, self.whole([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                self.remember(group, ids, np.diff(ends, prepend=0))
            else:
                other += group
        if other:
            got = self.whole(other)
            self.remember(other, np.concatenate(got), np.array([len(x) for x in got], np.int64))

    def remember(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ids.append(ids)
        self.sizes.append(sizes)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All remembered ids, and where those of each word start and how many they are."""
        if len(self.known) > REMEMBER:
            self.forget()
        if new := [w for w in words if w not in self.known]:
            self.learn(new)
        self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
        size = self.sizes[0]
        slot = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.ids[0], (np.cumsum(size) - size)[slot], size[slot]


def encoder(key: str, text: str) -> Encoder:
    if not _WORKER or _WORKER[0].key != key:
        _WORKER[:] = [Encoder(key, text)]
    return _WORKER[0]


def encode_texts(texts: pa.Array, key: str, tokenizer_json: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts in a row, and where each text's start (one more than texts)."""
    enc = encoder(key, tokenizer_json)
    texts = pc.fill_null(texts, "")
    odd = np.zeros(len(texts), bool)
    for token in enc.special:  # may hold what isn't split as words are
        odd |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
    # Some small letters join with a mark behind them that the capital doesn't join with, so texts with marks aren't made small here.
    odd |= pc.match_substring_regex(texts, MARKS).to_numpy(zero_copy_only=False)
    plain = pc.ascii_lower(pc.if_else(pa.array(odd), "", texts))
    # The library parts a letter or digit from a stop behind it too, and so more words are alike. It normalises first, so only letters
    # that stay one letter then are parted here: those of ASCII and small ones of Latin-1.
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, r"([a-z0-9ß-öø-ÿ])([,.;:!?])(\s|$)", r"\1 \2\3"))
    coded = lists.flatten().dictionary_encode()
    flat, first, size = enc.words(coded.dictionary.to_pylist())
    code = coded.indices.to_numpy()
    n = np.append(0, np.cumsum(size[code]))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    ends = n[offsets - offsets[0]]
    ids = flat[flat_ranges(first[code], size[code])]
    if odd.any():
        parts = np.split(ids, ends[1:-1])
        where = np.flatnonzero(odd).tolist()
        for i, got in zip(where, enc.whole([texts[i].as_py() for i in where]), strict=True):
            parts[i] = got
        ids = np.concatenate(parts)
        ends = np.append(0, np.cumsum([len(x) for x in parts]))
    at = ends + np.arange(len(ends))
    out = np.empty(at[-1], np.uint32)
    out[at[1:] - 1] = end_id
    keep = np.ones(at[-1], bool)
    keep[at[1:] - 1] = False
    out[keep] = ids
    return out, at


def cut_points(ids: np.ndarray, at: np.ndarray) -> Iterator[list[int]]:
    """For each document ids[at[i]:at[i + 1]] its chunks' edges, the document's own included."""
    h = mix(ids.astype(np.uint64) + ODD)
    roll = np.zeros(len(h), np.uint64)
    for k in range(min(LOOK, len(h))):
        roll[k:] = roll[k:] + h[: len(h) - k] * np.uint64(2 * k + 1)
    hits = np.flatnonzero(mix(roll) & MASK == 0) + 1
    lo = np.searchsorted(hits, at)
    for i in range(len(at) - 1):
        start, end = int(at[i]), int(at[i + 1])
        edges = [start]
        # A window must lie inside the document, which MIN > LOOK sees to for the first chunk.
        for hit in [*hits[lo[i] : lo[i + 1]].tolist(), end]:
            while hit - edges[-1] > MAX:
                edges.append(edges[-1] + MAX)
            if hit - edges[-1] >= MIN or hit == end and hit > edges[-1]:
                edges.append(hit)
        yield edges


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up as it is. Leaves and nodes are hashed apart."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)] + level[len(level) & ~1 :]
    return level[0] if level else hashlib.sha256(b"\0").digest()


def leaf(place: int, doc_id: int | None, start: int, n_tokens: int, root: bytes) -> bytes:
    """What a segment's root covers of one recipe row."""
    return f"{place},{doc_id},{start},{n_tokens},".encode() + root


@dataclass(frozen=True)
class TokenStore:
    """``chunks`` (hash, ids), ``recipes`` (segment, place, doc_id, start, n_tokens, hashes, root; start
    counts from the segment's), ``manifest`` (segment, first_doc, last_doc, n_docs, n_tokens, start, root)."""

    chunks: DataFrame
    recipes: DataFrame
    manifest: DataFrame
    width: int


CUT = "kind int, hash binary, ids binary, doc_id long, row long, n_tokens long, hashes binary, root binary"
RECIPE = "segment int, place long, doc_id long, start long, n_tokens long, hashes binary, root binary"
ORDERED = f"kind int, {RECIPE}, first_doc long, last_doc long, n_docs long"
SUMMARY = "segment int, first_doc long, last_doc long, n_docs long, n_tokens long, root binary"
MANIFEST = "segment int, first_doc long, last_doc long, n_docs long, n_tokens long, start long, root binary"


def write_store(docs: DataFrame, tokenizer_json: str, vocabulary: int, end_id: int) -> TokenStore:
    """Encodes documents (doc_id, text) and writes the store in the shared folder."""
    spark = docs.sparkSession
    width = 2 if vocabulary <= 1 << 16 else 4
    dtype, key = f"<u{width}", uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(tokenizer_json)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in CUT.split(", ")]
    ordered = [x.split()[0] for x in ORDERED.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for lo, hi in chunks([range(n) for n in lengths], 4 << 20):
                ids, at = encode_texts(batch.column(1).slice(lo, hi - lo), key, shared.value, end_id)
                raw = ids.astype(dtype).tobytes()
                rows = []
                for doc_id, edges in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), cut_points(ids, at), strict=True):
                    hashes = []
                    for a, b in zip(edges, edges[1:], strict=False):
                        part = raw[a * width : b * width]
                        hashes.append(h := hashlib.sha256(part).digest())
                        if h not in seen:
                            seen.add(h)
                            rows.append((1, h, part, None, None, None, None, None))
                    rows.append((0, None, None, doc_id, row, edges[-1] - edges[0], b"".join(hashes), merkle(hashes)))
                    row += 1
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops chunks that the partition, which has all of their kind, had before."""
        seen: set[bytes] = set()
        for b in batches:
            keep = [h is None or not (h in seen or seen.add(h)) for h in b.column(1).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: recipes; kind 1: the segment's summary, which needs no shuffle here as a partition is a segment."""
        segment, place, start = TaskContext.get().partitionId(), 0, 0
        first, last, leaves = None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n_tokens").to_numpy()
            at = start + np.cumsum(n) - n
            ids, places = b.column("doc_id").to_pylist(), range(place, place + len(n))
            leaves += map(leaf, places, ids, at.tolist(), n.tolist(), b.column("root").to_pylist())
            first, last = ids[0] if not place else first, ids[-1]
            none = pa.nulls(len(n), pa.int64())
            ints = (pa.array(np.full(len(n), 0), pa.int32()), pa.array(np.full(len(n), segment), pa.int32()), pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*ints, b.column("doc_id"), pa.array(at), b.column("n_tokens"), b.column("hashes"), b.column("root"), none, none, none], names=ordered)
            place, start = place + len(n), start + int(n.sum())
        if place:
            row = (1, segment, None, None, None, start, None, merkle(leaves), first, last, place)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=ordered)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, CUT)
    rows = rows.repartition(parts, F.coalesce("hash", F.col("row").cast("string").cast("binary"))).mapInArrow(once, CUT)
    both = written(rows, "token-store", ("kind",))
    stored = both.where("kind = 1").select("hash", "ids")
    recipes = both.where("kind = 0").select("doc_id", "row", "n_tokens", "hashes", "root")
    recipes = recipes.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").mapInArrow(order, ORDERED)
    both = written(recipes, "token-recipes", ("kind",))
    recipes = both.where("kind = 0").select([x.split()[0] for x in RECIPE.split(", ")])
    manifest = spark.createDataFrame(manifest_rows(both.where("kind = 1")), MANIFEST)
    return TokenStore(stored, recipes, written(manifest, "token-manifest"), width)


def summaries(recipes: DataFrame) -> DataFrame:
    """One row for each segment, made from its recipes; no document's data leaves its segment, only 32 bytes and
    the numbers of each."""

    def summary(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for b in rows:
            found += zip(*(b.column(c).to_pylist() for c in ("place", "doc_id", "start", "n_tokens", "root")), strict=True)
        found.sort(key=lambda x: x[0])
        out = (key[0].as_py(), found[0][1], found[-1][1], len(found), sum(x[3] for x in found), merkle([leaf(*x) for x in found]))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[x.split()[0] for x in SUMMARY.split(", ")])

    return recipes.select("segment", "place", "doc_id", "start", "n_tokens", "root").groupBy("segment").applyInArrow(summary, SUMMARY)


def manifest_rows(found: DataFrame) -> list[tuple]:
    """The manifest's rows in order. There is one for each segment, and segments are as many as partitions were written: small,
    so the running sum may be taken on the driver."""
    rows = sorted(((r.segment, r.first_doc, r.last_doc, r.n_docs, r.n_tokens, bytes(r.root)) for r in found.collect()), key=lambda r: r[0])
    before = np.cumsum([0, *(r[4] for r in rows)]).tolist()
    return [(*r[:5], before[i], r[5]) for i, r in enumerate(rows)]


def check_manifest(store: TokenStore) -> None:
    """Raises unless the recipes give exactly the manifest's rows."""
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    rows = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in store.manifest.select(names).collect()]
    want, got = {r[0]: r for r in rows}, {r[0]: r for r in manifest_rows(summaries(store.recipes))}
    if len(want) != len(rows):
        raise ValueError("the manifest has a segment twice")
    for segment in sorted(want.keys() | got.keys()):
        if segment not in got or segment not in want:
            raise ValueError(f"segment {segment} has no {'recipes' if segment in want else 'row in the manifest'}")
        differ = [n for n, x, y in zip(names, want[segment], got[segment], strict=True) if x != y]
        if differ:
            raise ValueError(f"segment {segment} doesn't have its {', '.join(differ)}")


def read_store(store: TokenStore) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, little-endian, 4 bytes an id) of every
    document, put together from its chunks and verified. The recipes are held against the manifest at once."""
    check_manifest(store)
    width = store.width
    recipes = store.recipes
    refs = recipes.select(
        "segment", "place", F.explode(F.sequence(F.lit(0), (F.length("hashes") / 32).cast("int") - 1)).alias("i"), "hashes"
    ).select("segment", "place", "i", F.substring("hashes", F.col("i") * 32 + 1, F.lit(32)).alias("hash"))
    parts = refs.join(store.chunks, "hash").groupBy("segment", "place").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("parts"))
    whole = recipes.drop("hashes").join(parts, ["segment", "place"], "left")
    base = store.manifest.select("segment", F.col("start").alias("base"))
    whole = whole.join(F.broadcast(base), "segment")  # a row for each segment
    whole = whole.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "root", F.col("parts.ids").alias("parts"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out = []
                for n, root, got in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    got = got or []
                    data = b"".join(got)
                    if len(data) != n * width or merkle([hashlib.sha256(x).digest() for x in got]) != root:
                        raise ValueError("a document's chunks don't have its root")
                    out.append(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["doc_id", "start", "ids"])

    return whole.mapInArrow(verify, "doc_id long, start long, ids binary")


def token_digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of ``read_store``'s rows."""
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
