"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols.

A document is cut at white space, special tokens' names are taken out, and the tokenizer file's own normaliser
and splitter make pieces of the rest, which never look across white space. In a piece all neighbours that may merge are
put in a queue by rank and place. The first is taken again and again: if its symbols have since been merged with others the entry
is stale and skipped, else both become one, which is linked with its neighbours, and the pairs it makes with them are put in
the queue. A piece of n symbols takes O(n log n) steps. Decoding looks ids up in the vocabulary and joins the strings.

Words are encoded once for each Python worker as long as they are remembered: of two generations of ``REMEMBER`` words the older
is forgotten when the younger is full, so memory is bounded and common words stay. Nothing is shuffled.

Defined results: a null or empty text, and one of white space alone, has no ids, and those decode to an empty string; repeated rows,
also with equal or null doc_id, are each encoded; a very long text or word is encoded like any other; an empty table gives an
empty one. Columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .texthash import chunks, flat_ranges

#: Bytes of text, and ids, that are worked on at once.
BLOCK, DECODED = 2 << 20, 1 << 19
#: Words of a generation, and words that are split at once.
REMEMBER, JOINED = 150_000, 512
_WORKER: list = []


class Merges:
    """The merges of a tokenizer file in the JSON format of the tokenizers library."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, added = spec["model"], spec.get("added_tokens", [])
        if model.get("type") != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE, without dropout, unknown tokens or fallbacks, is encoded here")
        if spec.get("decoder") is not None or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("the file has a decoder or special tokens that take more than their own name")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = [self.vocabulary[a] for a, _ in pairs]
        self.right = [self.vocabulary[b] for _, b in pairs]
        self.merged = [self.vocabulary[a + b] for a, b in pairs]
        self.rank = {a << 32 | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        tools = Tokenizer.from_str(text)
        self.normalise = tools.normalizer.normalize_str if tools.normalizer else str
        self.split = tools.pre_tokenizer.pre_tokenize_str if tools.pre_tokenizer else lambda s: [(s, (0, len(s)))]
        alone, together = ([[p for p, _ in self.split(self.normalise(x))] for x in xs] for xs in (("A", "b"), ("A \t\n b",)))
        if sum(alone, []) != sum(together, []):
            raise ValueError("the file's normaliser or splitter keeps white space, or looks across it")

    def piece(self, piece: str) -> list[int]:
        """The ids of a piece."""
        get = self.vocabulary.get
        ids = list(map(get, piece))
        ids[-1] = get(piece[-1] + self.suffix)
        if None in ids:
            ids = [x for x in ids if x is not None]
        n = len(ids)
        if n < 2:
            return ids
        rank, left, right, merged = self.rank.get, self.left, self.right, self.merged
        queue = [r << 32 | i for i, r in enumerate(map(rank, [a << 32 | b for a, b in zip(ids, ids[1:], strict=False)])) if r is not None]
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            top = heapq.heappop(queue)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j == n or ids[i] != left[r] or ids[j] != right[r]:
                continue  # stale
            new = ids[i] = merged[r]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank(new << 32 | ids[k])) is not None:
                    heapq.heappush(queue, x << 32 | i)
            h = before[i]
            if h >= 0 and (x := rank(ids[h] << 32 | new)) is not None:
                heapq.heappush(queue, x << 32 | h)
        return [x for x in ids if x >= 0]


class Remembered:
    """A dict of two generations: what is looked up moves to the younger, and when that is full the older is forgotten."""

    def __init__(self):
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def get(self, key: str) -> tuple | None:
        found = self.young.get(key)
        if found is None and (found := self.old.pop(key, None)) is not None:
            self.young[key] = found
        return found

    def turn(self) -> None:
        if len(self.young) > REMEMBER:
            self.old, self.young = self.young, {}


class Encoder:
    """Ids of words, each word worked out once while it is remembered."""

    def __init__(self, key: str, text: str):
        self.key, self.merges = key, Merges(text)
        #: An ASCII word that is a piece as it is stands among the pieces alone; words share the ids of their only piece.
        self.words, self.pieces = Remembered(), Remembered()

    def known(self, word: str) -> tuple | None:
        found = self.pieces.get(word) if word.isascii() else None
        return self.words.get(word) if found is None else found

    def piece(self, piece: str) -> tuple:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces.young[piece] = tuple(self.merges.piece(piece))
        return ids

    def word(self, word: str) -> tuple:
        m, out = self.merges, ()
        for k, part in enumerate(m.cut.split(word) if m.cut else [word]):
            if k % 2:
                out += (m.special[part],)
            elif part:
                for piece, _ in m.split(m.normalise(part)):
                    out += self.piece(piece)
        return out

    def learn(self, words: list[str]) -> list[tuple]:
        """The ids of words that aren't known. They are normalised and split many at a time, told apart by the spaces between them; those with
        special tokens, or with white space that isn't ASCII's, one by one."""
        m, learnt = self.merges, []
        for lo in range(0, len(words), JOINED):
            group = words[lo : lo + JOINED]
            joined = " ".join(group)
            text = "" if m.cut and m.cut.search(joined) else m.normalise(joined)
            parts = text.split(" ")
            if len(parts) != len(group):
                found = [self.word(w) for w in group]
            else:
                found = [()] * len(group)
                at, end = 0, len(parts[0])
                for piece, (_, stop) in m.split(text):
                    while stop > end:
                        at += 1
                        end += 1 + len(parts[at])
                    found[at] = found[at] + self.piece(piece) if found[at] else self.piece(piece)
            self.words.young.update((w, ids) for w, ids in zip(group, found, strict=True) if not (w.isascii() and w in self.pieces.young))
            learnt += found
        return learnt

    def texts(self, texts: pa.Array) -> pa.Array:
        """The ids of some texts, as lists."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten()
        blank = pc.equal(flat, "")
        coded = flat.filter(pc.invert(blank)).dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(self.known, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, self.learn([words[i] for i in new]), strict=True):
            found[i] = ids
        del words
        self.words.turn()
        self.pieces.turn()
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        code = coded.indices.to_numpy().astype(np.int64)
        at = np.append(0, np.cumsum(~blank.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()]
        ends = np.append(0, np.cumsum(size[code]))[at]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[flat_ranges((np.cumsum(size) - size)[code], size[code])], pa.int32()))


def encoder(key: str, text: str) -> Encoder:
    """The worker's encoder; built once for each ``key``."""
    if not _WORKER or _WORKER[0].key != key:
        _WORKER[:] = [Encoder(key, text)]
    return _WORKER[0]


def encode(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id and ids of each document (columns doc_id, text)."""
    Merges(tokenizer_json)  # what can't be encoded is refused before a job starts
    shared, key = docs.sparkSession.sparkContext.broadcast(tokenizer_json), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(key, shared.value)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for lo, hi in chunks([range(n) for n in lengths], BLOCK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), enc.texts(batch.column(1).slice(lo, hi - lo))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id, ids and decoded of rows with doc_id and ids: vocabulary strings, joined by a space as the library does for a file
    without a decoder. Null ids decode to an empty string; an id that the file doesn't have is left out."""
    m = Merges(tokenizer_json)
    by_id = {v: k for k, v in m.vocabulary.items()} | {v: k for k, v in m.special.items()}
    names = pa.array([by_id.get(i) for i in range(max(by_id, default=-1) + 1)], pa.string())
    shared = encoded.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_pylist()
            for lo, hi in chunks([range(n) for n in sizes], DECODED):
                part = batch.slice(lo, hi - lo)
                ids = part.column(1)
                flat = ids.flatten()
                known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names))), flat, pa.scalar(None, pa.int32()))
                ends = np.append(0, np.cumsum(sizes[lo:hi]))
                strings = names.take(known)
                if strings.null_count:
                    ends = np.append(0, np.cumsum(strings.is_valid().to_numpy(zero_copy_only=False)))[ends]
                    strings = strings.drop_null()
                out = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings), " ")
                yield pa.RecordBatch.from_arrays([part.column(0), ids, out], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
