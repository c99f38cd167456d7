"""A corpus from raw documents to token ids, in five stages.

Each stage takes what the one before it kept, in full; `run` writes every
stage's result as a table in the shared scratch folder and reads it again.
Stages return the columns of `documents`; the last one returns token ids.

Null texts count as empty and pass the filters; rows without a doc_id are never
near duplicates of anything; repeated rows are near duplicates, so one stays, the
first by its other columns; different texts under one doc_id all stay or go with it. An
empty table gives an empty table. Further columns of `documents` are carried on
up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bpe, decontaminate, ngram_join, substring_dedup, toxicity
from ravelin.llm.common import Scratch, read
from ravelin.llm.queries import tokenizer_file

TOXIC_FROM = 0.5
SHINGLE, LIKENESS = 5, (80, 100)
PASSAGE = 40  # words: longer passages that recur go


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM; fitted to all labels."""
    columns = docs.columns
    scored = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"), out="__score")
    return scored.filter(F.col("__score") < TOXIC_FROM).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    found = ngram_join.join_components(docs, k=SHINGLE, num=LIKENESS[0], den=LIKENESS[1], count=False)
    first = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(first, docs["doc_id"] == first["__id"]).drop("__id")
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    kept = kept.groupBy("doc_id", F.sha2("text", 256).alias("__sha")).agg(F.min_by(F.struct(*docs.columns), others).alias("__row")).select("__row.*")
    return kept.unionByName(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE words or more that occur earlier; a text of which nothing stays goes."""
    columns = docs.columns
    out = substring_dedup.remove_repeats(docs.withColumn("__text", F.col("text")), window=PASSAGE)
    cut = F.col("n_removed") > 0
    out = out.filter(~(cut & (F.col("kept") == "")))
    text = F.when(cut, F.col("kept")).otherwise(F.col("__text"))
    out = out.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256) of each document; ids is an array of int, the digest that of the text they decode to."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    out = bpe.encode_decode(docs, tokenizer_file("byte_bpe_50k.json"), keep=keep, as_list=True)
    return out.select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: A trained classifier and edit distances to passages can't be written in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, held = Scratch(spark), read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
            if held is not None:
                scratch.drop(held)
            held = docs
    return docs
