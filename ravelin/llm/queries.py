"""The registered queries of this subpackage: thin uses of the operators with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fingerprints, ngram_join, quality, substring_dedup, token_counts, toxicity, url_filter
from .common import held_out, read


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return labels.filter(~held_out(F.col("doc_id")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(read(spark, sf_dir, "documents"), _labels(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(read(spark, sf_dir, "documents"), _labels(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), window=20, keep=[])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), RULES)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_copies(read(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(read(spark, sf_dir, "conversations"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), keep=["doc_id"])
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_quality": op1_quality,
        "op2_toxicity": op2_toxicity,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_decontaminate": op5_decontaminate,
        "op6_token_counts": op6_token_counts,
        "op7_fingerprints": op7_fingerprints,
        "op8_ngram_join": op8_ngram_join,
        "op9_chat": op9_chat,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {}  # none of the methods can be written in SQL; tests hold them against brute force
