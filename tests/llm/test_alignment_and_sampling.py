"""BPE by a queue of merges, alignment of two tokenizers and importance resampling, against the libraries and plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quakeframe.llm import align, importance, merges, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [(None, "a b c d e " * 9), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "x" * 100_000), (6, "ä́  \x85 'll don't 12,5. <|endoftext|> <|im_end|>"), (7, "▁ one"), (8, "H̱ T̈ " * 20), (9, "one two three " * 5000), (10, "<s> <0x41>  two\n\n three "), (11, "one two three " * 5000)]


def strange_texts(n: int) -> list[str]:
    """Texts of letters, spaces of all kinds, marks and tokens' names."""
    r, pool = random.Random(3), [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    common = "abcdHTWYJI ..,'stremld\n\t  \r\xa0\x85\x1c\x0b 　éßΣςİ̱̈日本語\0"
    names = ["<|endoftext|>", "<|startoftext|>", "<s>", "<0x41>", "  the"]
    return ["".join(r.choice(common) if r.random() < 0.85 else r.choice(pool) if r.random() < 0.8 else r.choice(names) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    for name in ("ids", "block", "bucket", "docs", "score", "rank", "payload", "groups", "n_words", "t", "salt"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def word_bpe():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def both_files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# op11


def test_queue_of_merges_is_the_librarys(word_bpe):
    tool, own = Tokenizer.from_str(word_bpe), merges.Encoder("test", word_bpe)
    texts = strange_texts(4000)
    assert own.texts(pa.array(texts)).to_pylist() == [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]


def test_every_letter_is_encoded_as_the_library_does(word_bpe):
    tool, own = Tokenizer.from_str(word_bpe), merges.Encoder("test", word_bpe)
    texts = [f"a{chr(c)}b {chr(c)}'m 1{chr(c)}1 {chr(c)}" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert own.texts(pa.array(texts)).to_pylist() == [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_words_changes_nothing(word_bpe, monkeypatch):
    monkeypatch.setattr(merges, "REMEMBER", 5)
    tool, own = Tokenizer.from_str(word_bpe), merges.Encoder("test", word_bpe)
    texts = strange_texts(300)
    for t in (texts[:100], texts[100:200], texts[:100], texts[200:]):
        assert own.texts(pa.array(t)).to_pylist() == [e.ids for e in tool.encode_batch(t, add_special_tokens=False)]


def test_bpe_query(spark, docs, word_bpe):
    tool = Tokenizer.from_str(word_bpe)
    got = sorted(map(tuple, queries.op11_bpe(spark, SF).collect()))
    want = []
    for doc_id, text in docs:
        ids = tool.encode(text, add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tool.decode(ids, skip_special_tokens=False))))
    assert got == want


def test_bpe_of_odd_rows(odd, word_bpe):
    tool = Tokenizer.from_str(word_bpe)
    got = merges.decode(merges.encode(odd, word_bpe), word_bpe)
    want = [(d, tool.encode(t or "", add_special_tokens=False).ids) for d, t in ODD]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((d, ids, tool.decode(ids, skip_special_tokens=False)) for d, ids in want), key=str)
    assert merges.encode(odd.where("false"), word_bpe).count() == 0


def test_decoding_leaves_out_unknown_ids(spark, word_bpe):
    rows = spark.createDataFrame([(1, [320, -1, 10**6, 49407]), (2, None), (3, [])], "doc_id long, ids array<int>")
    names = Tokenizer.from_str(word_bpe)
    got = {r.doc_id: r.decoded for r in merges.decode(rows, word_bpe).collect()}
    assert got == {1: f"{names.id_to_token(320)} <|endoftext|>", 2: "", 3: ""}


def test_other_kinds_of_files_are_refused(both_files):
    with pytest.raises(ValueError, match="decoder"):
        merges.Merges(both_files[0])


# op12


def plain_alignment(texts, tokenizer_json, model):
    """Tokens, links and groups of whole texts, by the libraries and loops."""
    a_tool, b_tool = Tokenizer.from_str(tokenizer_json), sentencepiece.SentencePieceProcessor(model_proto=model)
    a_tool.encode_special_tokens = True
    alphabet, found = align.byte_alphabet(), []
    for text in texts:
        a, b = a_tool.encode(" " + (text or ""), add_special_tokens=False), b_tool.encode(text or "")
        spelled = [[bytes(alphabet[c] for c in t) for t in a.tokens], []]
        for i in b:
            p = b_tool.id_to_piece(i)
            spelled[1].append(bytes([int(p[3:-1], 16)]) if b_tool.is_byte(i) else p.replace("▁", " ").encode())
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            found.append(None)
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelled]
        links, first = [], 0
        for i, end in enumerate(ends[0]):
            start = ends[0][i - 1] if i else 0
            while ends[1][first] <= start:
                first += 1
            j = first
            while j < len(b) and (ends[1][j - 1] if j else 0) < end:
                links.append((a.ids[i], b[j]))
                j += 1
        cuts = sorted(set(ends[0]) & set(ends[1]))
        in_group = lambda ids, e: [[str(x) for x, y in zip(ids, e, strict=True) if lo < y <= hi] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(in_group(a.ids, ends[0]), in_group(b, ends[1]), strict=True)] if len(cuts) < 400 else None
        found.append((len(a.ids), len(b), len(cuts), links, groups))
    held = Counter(x for f in found if f for x in f[3])
    most: dict = {}
    for (_, b), n in held.items():
        most[b] = max(most.get(b, 0), n)
    out = [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(held[x] == most[x[1]] for x in f[3]), sum(held[x] for x in f[3]), f[4] and ";".join(f[4])) for f in found]
    return out, {(a, b, n, n == most[b]) for (a, b), n in held.items()}


def same(got, want):
    """Equal rows; groups of long texts aren't compared."""
    return all(g[:-1] == w[:-1] and (w[-1] is None or g[-1] == w[-1]) for g, w in zip(got, want, strict=True))


def test_alignment_of_strange_texts(spark, both_files):
    texts = strange_texts(1500) + ["", "  ", " ", "a ▁ b", "tail  ", "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    aligned, pairs = align.align(df, *both_files)
    want, held = plain_alignment(texts, *both_files)
    got = [tuple(r)[1:] for r in sorted(aligned.collect(), key=lambda r: r.doc_id)]
    assert same(got, want) and sum(w[0] == 0 for w in want) > 10
    assert {tuple(r) for r in pairs.collect()} == held


def test_alignment_query(spark, docs, both_files):
    got = [tuple(r) for r in sorted(queries.op12_token_alignment(spark, SF).collect(), key=lambda r: r.doc_id)]
    want, _ = plain_alignment([t for _, t in docs], *both_files)
    assert [g[:-1] for g in got] == [(d, *w[:-1]) for (d, _), w in zip(docs, want, strict=True)]
    short = [(g[-1], w[-1]) for g, w in zip(got, want, strict=True) if w[-1] is not None]
    assert len(short) > 50 and all(g == (w and sha(w)) for g, w in short)


def test_alignment_in_small_blocks(spark, docs, both_files, monkeypatch):
    """Pairs are counted over blocks, and chunks are encoded in many texts."""
    monkeypatch.setattr(align, "BLOCK", 3000)
    monkeypatch.setattr(align, "JOINED", 100)
    df = spark.createDataFrame(docs[:60], DOCS).repartition(2)
    got = [tuple(r)[1:] for r in sorted(align.align(df, *both_files)[0].collect(), key=lambda r: r.doc_id)]
    assert same(got, plain_alignment([t for _, t in docs[:60]], *both_files)[0])


def test_alignment_of_odd_rows(odd, both_files):
    got = sorted((tuple(r) for r in align.align(odd, *both_files)[0].collect()), key=lambda r: (str(r[0]), r[1:]))
    want = plain_alignment([t for _, t in ODD], *both_files)[0]
    want = sorted(((d, *w) for (d, _), w in zip(ODD, want, strict=True)), key=lambda r: (str(r[0]), r[1:-1]))
    assert same(got, want)
    none, pairs = align.align(odd.where("false"), *both_files)
    assert none.count() == 0 and pairs.count() == 0


# op13


def plain_sample(docs, target, n, buckets, seed, least, percent):
    def found(text):
        words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())  # bytes.lower() is ASCII's
        return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    own, wanted = [found(t) for _, t in docs], [found(t) for t in target]
    s, t = (Counter(x for _, f in side for x in f) for side in (own, wanted))
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for (doc_id, _), (words, f) in zip(docs, own, strict=True):
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    eligible = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(eligible[: len(eligible) * percent // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def test_resampling_query(spark, docs):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(map(tuple, queries.op13_importance_resampling(spark, SF).collect()))
    assert got == plain_sample(docs, target, 1, 10_000, 2024, 20, 10) and sum(r[4] is not None for r in got) > 5


def test_resampling_by_trigrams_in_small_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 4000)
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    df, wanted = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([(t,) for t in [*target, None]], "text string")
    got = sorted(map(tuple, importance.resample(df, wanted, n=3, buckets=500, seed=7, least_words=40, percent=25).collect()))
    assert got == plain_sample(docs, target, 3, 500, 7, 40, 25)


def test_resampling_of_odd_rows(spark, odd):
    target = ["one two", "", None, "x" * 100]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    key = lambda r: (str(r[0]), r[1:4], r[4] or 99)
    got = sorted(map(tuple, importance.resample(odd, wanted, percent=50).collect()), key=key)
    want = plain_sample(ODD, target, 1, 10_000, 2024, 20, 50)
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want, key=key)]
    assert sorted((r[0] is None, r[0], r[4]) for r in got if r[4]) == sorted((r[0] is None, r[0], r[4]) for r in want if r[4])
    assert importance.resample(odd.where("false"), wanted).count() == 0
    nothing = importance.resample(odd, wanted.where("false"), percent=50).collect()
    assert sorted((str(r.doc_id), r.weight) for r in nothing) == sorted((str(r[0]), r[2]) for r in plain_sample(ODD, [], 1, 10_000, 2024, 20, 50))


def test_crc_of_spans():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(3000))
    spans = [(0, 0), (5, 1), (0, 64), (1, 65), (7, 2000), *((r.randrange(2000), r.randrange(100)) for _ in range(300))]
    start, size = map(np.array, zip(*spans, strict=True))
    assert importance.span_crcs(np.frombuffer(data, np.uint8), start, size).tolist() == [zlib.crc32(data[a : a + n]) for a, n in spans]


def test_workers_that_encode_nothing_keep_no_tokenizers(monkeypatch):
    monkeypatch.setattr(align, "tokenizers", lambda key, shared: align._WORKER.append("pair") or SimpleNamespace(a="a", b="b"))
    assert align.spelled("only here", None) == ("a", "b") and not align._WORKER
    align._SPELLED.clear()
