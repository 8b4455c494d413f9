"""The pipeline's stages against plain versions of what they do, stage by stage."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from quakeframe.llm import bpe, quality, suffix
from quakeframe.llm.common import written
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def as_dict(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["quality-classifier", "ngram-jaccard-join", "suffix-array-dedup", "benchmark-decontamination", "byte-level-bpe"]
    before = docs
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality", quality.learnable(3, 1))
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in stages:
        after = written(stage(spark, before, SF), name)
        old = as_dict(before)
        if name != stages[-1][0]:
            assert sorted(after.columns) == sorted(columns)
            new = as_dict(after)
            assert set(new) <= set(old)
        if name == "quality-classifier":
            assert set(new) == {r.doc_id for r in quality.score(before, model).collect() if r.score >= 0.5}
        elif name == "ngram-jaccard-join":
            assert set(new) == {d for d, _, c in brute_components(sorted(old.items()), 5, 80, 100) if c == d}
        elif name == "suffix-array-dedup":
            want = {d: (n, removed) for d, n, removed, _, _ in suffix.brute_force([(d, t.encode()) for d, t in old.items()], 50)}
            assert set(new) == {d for d, (n, removed) in want.items() if removed == 0 or removed < n}
            assert all(new[d] == old[d] for d in new if want[d][1] == 0)
        elif name == "benchmark-decontamination":
            assert set(new) == {d for d, t in old.items() if not any(b in t for b in bench)}
        else:
            ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
            enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert {r.doc_id: (list(r.ids), r.decoded_sha256) for r in after.collect()} == {d: (enc.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in old.items()}
        before = after


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "en", "s", 0), (None, "a", "en", "s", 1), (3, "", None, None, None), (4, "x " * 500, "en", "s", 1000), (4, "x " * 500, "en", "s", 1000)], "doc_id long, text string, lang string, source string, n_chars int")
    more = docs.selectExpr("*", "'x' as score", "1 as row", "2 as number", "'y' as kept", "3 as n_removed", "4 as component_id", "5 as node", "6 as ids", "7 as raw")
    for d in (docs, docs.where("false"), more):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, d, SF)
            got.collect()
            assert name == "byte-level-bpe" or sorted(got.columns) == sorted(docs.columns)
