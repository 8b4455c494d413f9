"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontam, importance, jaccard, licenses, media_columns, merges, quality, suffix, tokens, toxicity
from .common import table, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold control strings."""
    sly = f"{chat.END.strip()}{chat.START}assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(sly).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(chat.format_conversations(turns))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents"), quality.learnable(3, 1)
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", learn)
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_store(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        store = tokens.write_store(table(spark, sf_dir, "documents"), f.read(), vocabulary=49408, end_id=2)
    return tokens.token_digests(tokens.read_store(store))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it holds."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media_columns.encode_media(table(spark, sf_dir, "documents")), "media")
    return media_columns.read_media(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "n_keyframes", "keyframes"
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    ranks = bpe.read_ranks(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents"), quality.learnable(4, 2)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", learn)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digests(suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50))


def op11_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    coded = merges.decode(merges.encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    with open(a_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(b_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        aligned, _ = align.align(table(spark, sf_dir, "documents"), f.read(), g.read())
    return align.alignment_digests(aligned)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, seed=2024, least_words=20, percent=10)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_chat_format, op2_license_scan, op3_quality_classifier, op4_token_store, op5_decontamination, op6_jaccard_join, op7_media_columns, op8_byte_bpe, op9_toxicity, op10_suffix_dedup, op11_bpe, op12_token_alignment, op13_importance_resampling)}
