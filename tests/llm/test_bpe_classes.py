"""Every code point is split as the library does."""

import public_tokenizers
import tiktoken

from quakeframe.llm import bpe


def test_all_code_points_in_contexts_that_show_their_class(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = bpe.Splitter(public_tokenizers.PATTERN)
    wrong = 0
    for lo in range(0, 0x110000, 1 << 12):
        texts = [f"{c}'m 1{c}1 {c}" for c in map(chr, range(lo, lo + (1 << 12))) if not 0xD800 <= ord(c) < 0xE000]
        want = enc.encode_ordinary_batch(texts, num_threads=4)
        for text, ids in zip(texts, want, strict=True):
            own = [i for piece in split.findall(text) for i in enc.encode_ordinary(piece)]
            wrong += own != ids
    assert wrong == 0 and len(split.stand_ins) > 1000
    strange = [c for c in ("\U00018f2f", "ౝ", "೜", "꟎") if c]
    df = spark.createDataFrame([(k, f"{c}'m 1{c}1") for k, c in enumerate(strange)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, ranks, public_tokenizers.PATTERN).collect()}
    assert got == {k: enc.encode_ordinary(f"{c}'m 1{c}1") for k, c in enumerate(strange)}


def test_words_that_are_forgotten_are_encoded_again(spark, monkeypatch):
    from quakeframe.llm import merges

    monkeypatch.setattr(merges, "REMEMBER", 3)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(k, f"word{k % 7} other{k % 5} same") for k in range(50)], "doc_id long, text string")
    assert all(r.ids == enc.encode_ordinary(f"word{r.doc_id % 7} other{r.doc_id % 5} same") for r in bpe.encode(df, ranks, public_tokenizers.PATTERN).collect())
