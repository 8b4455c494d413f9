"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which tokens of another.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece model that puts a space before a text; both encode a space
and the text. Neither merges across the edge between a character that isn't white space and a space, so a block of documents is cut there
into chunks, each different chunk of the block is encoded once (many in one text, told apart by the bytes of their tokens), and
all of the block's chunks are aligned together in numpy: the ends of tokens are cumulated bytes, the ends that both have (``intersect1d``)
cut the tokens into groups (``searchsorted``), and each A token is repeated for the B tokens whose bytes overlap its own.

A block then has one row for each id pair that it links, with the number of links. The pairs' counts come from two
shuffles, first with a salt, and go back to the block as one row for each of its pairs; there they are summed for documents. A block has some
megabytes (a longer text is a block by itself), so no task or group grows with the corpus, and a pair that every document has is one row
a block.

Defined results: a null or empty text, or one whose tokens don't spell a space and the text in either tokenizer (as with U+2581, B's own
sign for a space), has no tokens: counts are 0 and ``groups`` is empty; special tokens' names inside texts are plain text. Repeated rows, also with equal or
null doc_id, are aligned each and all count. An empty table gives an empty one. A very long text, or one without any space, is aligned whole.
Columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

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

from .bpe import pack, unpack
from .common import give_back, gives_back, written
from .texthash import chunks, flat_ranges

#: Bytes of text of a block, and of chunks that are encoded in one text.
BLOCK, JOINED = 4 << 20, 1 << 16
#: Parts that a pair's counts are first summed in.
SALTS = 8
_WORKER: list = []
_SPELLED: list = []


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 stands for itself, the rest follow from U+0100."""
    same = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Spellings:
    """The bytes of a vocabulary's tokens in a row, and each token's start (one more than tokens)."""

    data: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Spellings:
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.append(0, np.cumsum([len(t) for t in tokens])))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.start[ids + 1] - self.start[ids]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[flat_ranges(self.start[ids], self.sizes(ids))]


class Pair:
    """Both tokenizers and their tokens' bytes."""

    def __init__(self, key: str, tokenizer_json: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.key = key
        self.a_tool = Tokenizer.from_str(tokenizer_json)
        self.a_tool.encode_special_tokens = True
        self.a_tool.no_truncation()
        self.a_tool.no_padding()
        self.b_tool = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = {v: k for k, v in self.a_tool.get_vocab(with_added_tokens=True).items()}
        alphabet = byte_alphabet()
        self.a = Spellings.of([bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode() for name in (names.get(i, "") for i in range(max(names) + 1))])
        b = self.b_tool
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b = Spellings.of([bytes([int(n[3:-1], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        #: B may be given many chunks at once if no token has a space behind another character.
        self.b_parts = not any(" " in n.replace("▁", " ").lstrip(" ") for n in names)

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.a_tool.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        """Texts start with a space, which B puts there itself."""
        return [np.array(x, np.int64) for x in self.b_tool.encode([t[1:] for t in texts], num_threads=1)]

    def encode(self, data: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of A and of B of some chunks in a row, how many each chunk has, and whether it is spelled right. ``whole``: chunks that can't
        be told apart from what follows them, and are encoded by themselves."""
        n, starts = len(ends), np.append(0, ends[:-1])
        ids, sizes, right = [], [], np.ones(n, bool)
        own = whole | (not self.b_parts)
        # runs of chunks that are encoded together
        lengths = np.where(own, JOINED, ends - starts)
        run = np.cumsum(own | np.append(True, own[:-1])[:n]) * (n + 1) + (np.cumsum(lengths) - lengths) // JOINED
        first = np.flatnonzero(np.diff(run, prepend=-1))
        edge = np.append(first, n)
        texts = [data[starts[i] : ends[j - 1]].tobytes().decode() for i, j in zip(edge[:-1], edge[1:], strict=True)]
        for spellings, encode in ((self.a, self.encode_a), (self.b, self.encode_b)):
            out, counts = [], np.zeros(n, np.int64)
            for got, i, j in zip(encode(texts), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                cut = self.told_apart(spellings, got, data, starts[i:j], ends[i:j])
                if cut is None and j - i > 1:  # one of them isn't spelled right: find out which
                    alone = encode([data[starts[k] : ends[k]].tobytes().decode() for k in range(i, j)])
                    fine = [self.told_apart(spellings, x, data, starts[k : k + 1], ends[k : k + 1]) is not None for k, x in zip(range(i, j), alone, strict=True)]
                    right[i:j] &= fine
                    got, cut = np.concatenate(alone), np.array([len(x) for x in alone])
                elif cut is None:
                    right[i] = False
                    cut = np.array([len(got)])
                out.append(got)
                counts[i:j] = cut
            ids.append(np.concatenate(out) if out else np.zeros(0, np.int64))
            sizes.append(counts)
        for k in range(2):  # chunks that aren't right have no tokens
            ids[k] = ids[k][np.repeat(right, sizes[k])]
            sizes[k] = np.where(right, sizes[k], 0)
        return ids, sizes, right

    @staticmethod
    def told_apart(spellings: Spellings, ids: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """How many ids each of some chunks in a row has; None if they don't spell them."""
        at = np.cumsum(spellings.sizes(ids))
        if (at[-1] if len(at) else 0) != ends[-1] - starts[0] or not np.array_equal(spellings.spell(ids), data[starts[0] : ends[-1]]):
            return None
        found = np.searchsorted(at, ends - starts[0])
        return np.diff(found + 1, prepend=0) if np.array_equal(at[found], ends - starts[0]) else None


def tokenizers(key: str, shared) -> Pair:
    """The worker's tokenizers; built once for each ``key``."""
    if not _WORKER or _WORKER[0].key != key:
        _WORKER[:] = [Pair(key, *shared.value)]
    return _WORKER[0]


def spelled(key: str, shared) -> tuple[Spellings, Spellings]:
    """Both tokenizers' spellings, for workers that encode nothing: these keep no tokenizers."""
    if not _SPELLED or _SPELLED[0] != key:
        pair = tokenizers(key, shared)
        _SPELLED[:] = [key, pair.a, pair.b]
        del pair
        _WORKER.clear()
        give_back()
    return _SPELLED[1], _SPELLED[2]


def cut_chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of documents that start at ``starts`` start, and whether what stands before a place is white space:
    before each run of spaces that follows a character that isn't white space and is followed by another character."""
    space = data == 32
    p1, p2, p3 = (np.concatenate([np.zeros(k, np.uint8), data])[: len(data) + 1] for k in (1, 2, 3))  # the bytes before each place
    # ASCII's white space and separators, U+0085 and U+00A0, and all that may be one of U+1680, U+2000 to U+203F, U+205F and U+3000
    blank = (p1 == 32) | ((p1 >= 9) & (p1 <= 13)) | ((p1 >= 28) & (p1 <= 31)) | ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)))
    blank |= ((p3 == 0xE1) & (p2 == 0x9A)) | ((p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81))) | ((p3 == 0xE3) & (p2 == 0x80))
    cut = np.flatnonzero(space & ~blank[:-1])
    others = np.flatnonzero(~space)
    after = np.append(others, len(data))[np.searchsorted(others, cut)]
    doc_end = np.append(starts, len(data))[np.searchsorted(starts, cut, "right")]
    return np.union1d(cut[after < doc_end], starts), blank


@dataclass
class Aligned:
    """A block's chunks, aligned. ``group_a`` and ``group_b`` number the groups through all chunks; link i joins tokens ``link_a[i]`` and
    ``link_b[i]``; the other four give each chunk's first (one more than chunks)."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    first_group: np.ndarray
    first_link: np.ndarray

    def codes(self, width: int) -> np.ndarray:
        return self.a[self.link_a] * width + self.b[self.link_b]


def align_chunks(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, bytes_a: Spellings, bytes_b: Spellings) -> Aligned:
    """Both tokenizers' ids of the same chunks, and how many each chunk has of either."""
    first_a, first_b = np.append(0, np.cumsum(size_a)), np.append(0, np.cumsum(size_b))
    long_a = bytes_a.sizes(a)
    end_a, end_b = np.cumsum(long_a), np.cumsum(bytes_b.sizes(b))
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    lo = np.searchsorted(end_b, end_a - long_a, "right")
    n = np.searchsorted(end_b, end_a) - lo + 1
    first_link = np.append(0, np.cumsum(n))[first_a]
    first_group = np.searchsorted(common, np.append(0, end_a)[first_a], "right")
    return Aligned(a, b, group_a, group_b, np.repeat(np.arange(len(a)), n), flat_ranges(lo, n), first_a, first_b, first_group, first_link)


def group_strings(x: Aligned) -> list[bytes]:
    """Each chunk's groups, as ``a1,a2|b1;``."""
    ids = np.concatenate([x.a, x.b])
    order = np.argsort(np.concatenate([2 * x.group_a, 2 * x.group_b + 1]), kind="stable")
    side = np.repeat([0, 1], [len(x.a), len(x.b)])[order]
    group = np.concatenate([x.group_a, x.group_b])[order]
    digits = Spellings.of([b"%d," % i for i in range(int(ids.max(initial=0)) + 1)])
    text = digits.spell(ids[order]).copy()
    ends = np.cumsum(digits.sizes(ids[order]))
    last = np.append(side[1:] != side[:-1], True) | np.append(group[1:] != group[:-1], True) if len(ids) else np.zeros(0, bool)
    text[ends[last & (side == 0)] - 1] = ord("|")
    text[ends[last & (side == 1)] - 1] = ord(";")
    edge = np.append(0, ends)[x.first_a + x.first_b].tolist()  # a chunk's tokens lie together
    whole = text.tobytes()
    return [whole[i:j] for i, j in zip(edge, edge[1:], strict=False)]


BLOCKS = "kind int, block long, a int, b int, n long, payload binary"


def tokenize(docs: DataFrame, shared, key: str) -> DataFrame:
    """Kind 0: a block's documents and chunks; kind 1: an id pair of the block and how many of its links have it."""

    def rows(block: int, doc_ids: list, texts: list[str | None], pair: Pair) -> Iterator[pa.RecordBatch]:
        full = [b" " + t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(full), np.uint8)
        length = np.array([len(x) for x in full], np.int64)
        doc_start = np.cumsum(length) - length
        if len(data) > np.iinfo(np.int32).max:
            raise ValueError("a text has over 2 GB")
        starts, blank = cut_chunks(data, doc_start[length > 0]) if len(data) else (np.zeros(0, np.int64), None)
        edges = pa.array(np.append(starts, len(data)), pa.int32())
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, edges.buffers()[1], pa.py_buffer(data.tobytes())]).dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        ends = np.frombuffer(coded.dictionary.buffers()[1], np.int32, len(coded.dictionary) + 1)[1:].astype(np.int64)
        own = np.zeros(len(ends), bool)
        if len(ends):
            own[number] = blank[np.append(starts[1:], len(data))]
        (a, b), (size_a, size_b), right = pair.encode(np.frombuffer(coded.dictionary.buffers()[2], np.uint8, ends[-1]) if len(ends) else data, ends, own)
        at = np.searchsorted(starts, np.append(doc_start, len(data)))
        wrong = np.append(0, np.cumsum(~right[number]))
        good = wrong[at[1:]] == wrong[at[:-1]]
        count = np.where(good, np.diff(at), 0)
        number = number[flat_ranges(at[:-1], count)]
        x = align_chunks(a, b, size_a, size_b, pair.a, pair.b)
        times = np.bincount(number, minlength=len(ends))
        width = len(pair.b.start)
        code, which = np.unique(x.codes(width), return_inverse=True)
        weight = np.repeat(times, np.diff(x.first_link))
        order = np.argsort(which, kind="stable")
        total = np.append(0, np.cumsum(weight[order]))[np.append(np.searchsorted(which[order], np.arange(len(code))), len(which))]
        n = np.diff(total)
        code, n = code[n > 0], n[n > 0]
        null = np.array([d is None for d in doc_ids], np.int64)
        head = np.concatenate([[len(doc_ids), len(ends), len(a), len(b)], count, null, number, size_a, size_b, a, b])
        yield pa.RecordBatch.from_pydict({"kind": pa.array([0], pa.int32()), "block": pa.array([block]), "a": pa.nulls(1, pa.int32()), "b": pa.nulls(1, pa.int32()), "n": pa.nulls(1, pa.int64()), "payload": pa.array([pack(head, np.array([d or 0 for d in doc_ids], "<i8").tobytes())], pa.binary())})
        k = len(code)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(k, np.int32)), "block": pa.array(np.full(k, block)), "a": pa.array((code // width).astype(np.int32)), "b": pa.array((code % width).astype(np.int32)), "n": pa.array(n), "payload": pa.nulls(k, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block = tokenizers(key, shared), TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for lo, hi in chunks([range(n) for n in sizes], BLOCK):
                yield from rows(block, batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), pair)
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(gives_back(run), BLOCKS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best) of rows with block, a, b, n: links that hold a pair, and whether no pair with its B id is held by more."""
    part = pairs.groupBy("a", "b", F.pmod("block", F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = part.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align(docs: DataFrame, tokenizer_json: str, model: bytes) -> tuple[DataFrame, DataFrame]:
    """The aligned documents (doc_id, numbers of tokens, groups and links, links whose pair is their B id's commonest, sum of the links'
    counts, and ``groups`` as text: decimal ids, ``a1,a2|b1;a3|b2,b3``) and the table of pairs (a, b, count, best)."""
    shared, key = docs.sparkSession.sparkContext.broadcast((tokenizer_json, model)), uuid.uuid4().hex
    both = written(tokenize(docs, shared, key), "aligned", ("kind",))
    pairs = both.where("kind = 1").select("block", "a", "b", "n")
    counts = written(pair_counts(pairs), "pair-counts")
    marks = pairs.select("block", "a", "b").join(counts, ["a", "b"])

    def finish(blocks: pa.Table, marks: pa.Table) -> pa.Table:
        give_back()  # what the group before has freed
        spelled_a, spelled_b = spelled(key, shared)
        numbers, raw = unpack(blocks.column("payload")[0].as_py())
        n_docs, n_chunks, n_a, n_b = numbers[:4].tolist()
        cut = np.cumsum([4, n_docs, n_docs, 0, n_chunks, n_chunks, n_a, n_b])
        count = numbers[4 : cut[1]]
        cut[3:] += int(count.sum())
        null, number, size_a, size_b, a, b = (numbers[i:j] for i, j in zip([cut[1], cut[2], *cut[3:-1]], [cut[2], *cut[3:]], strict=True))
        x = align_chunks(a, b, size_a, size_b, spelled_a, spelled_b)
        width = len(spelled_b.start)
        code = marks.column("a").to_numpy().astype(np.int64) * width + marks.column("b").to_numpy()
        order = np.argsort(code)
        at = np.searchsorted(code[order], x.codes(width))
        at = order[np.minimum(at, len(order) - 1)] if len(order) else np.zeros(0, np.int64)
        here = np.repeat(np.bincount(number, minlength=n_chunks) > 0, np.diff(x.first_link))  # chunks of other documents only have no marks
        best = marks.column("best").to_numpy().astype(np.int64)[at] * here if len(order) else np.zeros(len(here), np.int64)
        held = marks.column("count").to_numpy()[at] * here if len(order) else np.zeros(len(here), np.int64)
        edge = np.append(0, np.cumsum(count))
        each = [np.diff(x.first_a), np.diff(x.first_b), np.diff(x.first_group), np.diff(x.first_link)]
        each += [np.diff(np.append(0, np.cumsum(v))[x.first_link]) for v in (best, held)]
        sums = [np.diff(np.append(0, np.cumsum(v[number]))[edge]) for v in each]
        strings, places = group_strings(x), number.tolist()
        groups = [b"".join([strings[k] for k in places[i:j]])[:-1] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        columns = [pa.array(np.frombuffer(raw, "<i8"), mask=null.astype(bool)), *(pa.array(s, pa.int64()) for s in sums), pa.array(groups, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    payloads = both.where("kind = 0").select(F.col("block").alias("place"), "payload")
    found = payloads.groupBy("place").cogroup(marks.groupBy("block")).applyInArrow(finish, ALIGNED)
    return found, counts


def alignment_digests(aligned: DataFrame) -> DataFrame:
    """The numbers of ``align``'s documents, and the groups' hash ('' without tokens)."""
    return aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
