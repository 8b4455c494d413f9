"""The queries op3 to op10 themselves, over whole tables, against plain versions of what they promise."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quakeframe.llm import media, quality, queries, suffix, toxicity
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def rows(spark, name):
    return sorted(queries.queries()[name](spark, SF).collect(), key=lambda r: r.doc_id)


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_features(text):
    """Feature numbers of a text, one word and one byte at a time."""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    hashed = [mix((sum((c + 1) * pow(0x100000001B3, k, 1 << 64) for k, c in enumerate(w)) + len(w)) & M) for w in words]
    hashed = [0x5A5A5A5A if k and words[k] == words[k - 1] else h for k, h in enumerate(hashed)]
    found = {mix(h) >> 46 for h in hashed}
    found |= {mix(mix((a * ODD + b) & M) * ODD & M) >> 46 for a, b in zip(hashed, hashed[1:], strict=False)}
    return sorted(found | {mix(raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16 | 1 << 40) >> 46 for k in range(len(raw) - 2)})


def plain_score(model, text):
    """Of the best window, one word after the other."""
    if model["net"] is None:
        return 1 / (1 + np.exp(-model["b"]))
    p = {k: v.astype(float) for k, v in model["net"].items()}
    number, _, (grams, sizes), places = toxicity.encode([text.encode()])
    at = np.cumsum(sizes) - sizes
    vector = [p["words"][places[k] >> 2] + p["evidence"][places[k]] * p["voice"] + p["chars"][grams[at[k] : at[k] + sizes[k]]].mean(axis=0) for k in number]
    starts = [0] if len(vector) <= 64 else [*range(0, len(vector) - 64, 32), len(vector) - 64]
    best = -np.inf
    s = toxicity.STATES
    for a in starts:
        states = {}
        for d in "fb":
            h, out = np.zeros(s), []
            own = vector[a : a + 64]
            for x in own if d == "f" else own[::-1]:
                g = x @ p[f"in_{d}"] + p[f"bias_{d}"]
                r, z = (1 / (1 + np.exp(-(g[i : i + s] + h @ p[f"rec_{d}"][:, i : i + s]))) for i in (0, s))
                c = np.tanh(g[2 * s :] + (h * r) @ p[f"rec_{d}"][:, 2 * s :])
                h = (1 - z) * h + z * c
                out.append(h)
            states[d] = out if d == "f" else out[::-1]
        both = [np.concatenate(x) for x in zip(states["f"], states["b"], strict=True)]
        weight = np.exp([np.tanh(h @ p["att"]) @ p["key"] for h in both])
        pooled = sum(w * h for w, h in zip(weight / weight.sum(), both, strict=True)) if both else np.zeros(2 * s)
        best = max(best, pooled @ p["out"] + p["bias"][0])
    return 1 / (1 + np.exp(-(model["a"] * best + model["b"])))


@pytest.mark.parametrize("name, n, held, least", [("op3_quality_classifier", 3, 1, 0.5), ("op9_toxicity", 4, 2, 0.3)])
def test_classifiers(spark, docs, name, n, held, least):
    got = rows(spark, name)
    assert [r.doc_id for r in got] == [d for d, _ in docs]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == held) and r.predicted == (r.score >= least) and 0 <= r.score <= 1 for r in got)
    tables = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    if n == 3:
        m = quality.train(*tables, "quality", quality.learnable(n, held))
        for r, (_, text) in zip(got[:60], docs, strict=False):
            x = plain_features(text)
            v = m["r"][x]
            margin = m["w"][x] @ v / np.sqrt(v @ v) + m["bias"] if len(x) else m["bias"]
            assert abs(r.score - 1 / (1 + np.exp(-(m["a"] * margin + m["b"])))) < 1e-9
    else:
        m = toxicity.train(*tables, "toxic", quality.learnable(n, held))
        for r, (_, text) in zip(got[:25], docs, strict=False):
            assert abs(r.score - plain_score(m, text)) < 2e-3


def test_token_store(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for r, (doc_id, text) in zip(rows(spark, "op4_token_store"), docs, strict=True):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if x in t}


def test_jaccard_join(spark, docs):
    assert sorted(map(tuple, queries.op6_jaccard_join(spark, SF).collect()), key=str) == brute_components(docs, 4, 85, 100)


def test_media_columns(spark, docs):
    for r, (doc_id, text) in zip(rows(spark, "op7_media_columns"), docs, strict=True):
        data = text.encode()
        whole = data + bytes(max(64 - len(data), -len(data) % 64))
        stored = media.store_media(data)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (doc_id, len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and r.n_keyframes == len(r.keyframes) == -(-len(whole) // 1024)
        assert all(stored[k.offset : k.offset + k.length] == whole[1024 * i : 1024 * i + 64] for i, k in enumerate(r.keyframes))


def test_byte_bpe(spark, docs):
    ranks = {}
    import base64

    for line in open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"):
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r, (doc_id, text) in zip(rows(spark, "op8_byte_bpe"), docs, strict=True):
        ids = enc.encode_ordinary(text)
        assert (r.doc_id, r.n_tokens) == (doc_id, len(ids)) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_suffix_dedup(spark, docs):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op10_suffix_dedup")]
    assert got == suffix.brute_force([(d, t.encode()) for d, t in docs], 50)
