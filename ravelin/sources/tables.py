"""Reference-shaped tables (nodes, edges, evidence, claims) made of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranges


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store that doesn't exist yet reads as an empty table of its schema."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def node_id(kind: str, key) -> "F.Column":
    return F.concat(F.lit(f"node::{kind}::"), key.cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for kind, table, key, name in (
        ("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"),
        ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"),
    ):
        parts.append(load(spark, sf_dir, table).select(node_id(kind, F.col(key)).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("display_name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region contains nation contains customer and supplier: (id, kind, src, dst)."""

    def edge(table, src_kind, src_key, dst_kind, dst_key):
        return load(spark, sf_dir, table).select(node_id(src_kind, F.col(src_key)).alias("src"), node_id(dst_kind, F.col(dst_key)).alias("dst"))

    out = edge("nation", "region", "n_regionkey", "nation", "n_nationkey").unionByName(edge("customer", "nation", "c_nationkey", "customer", "c_custkey")).unionByName(edge("supplier", "nation", "s_nationkey", "supplier", "s_suppkey"))
    return out.select(F.concat_ws("::", F.lit("edge::contains"), "src", "dst").alias("id"), F.lit("contains").alias("kind"), "src", "dst")


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part imports the next part of the same order; a pair is uncertain if any of its lines is."""
    lines = load(spark, sf_dir, "lineitem")
    n = ranges.parts(lines)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = lines.repartition(n, "l_orderkey").select("l_partkey", F.lead("l_partkey").over(w).alias("nxt"), ((F.col("l_discount") < 0.02) | (F.col("l_linestatus") == "O")).alias("unc"))
    pairs = pairs.filter("nxt is not null and nxt <> l_partkey").select(F.col("l_partkey").alias("src"), F.col("nxt").alias("dst"), "unc")
    return pairs.repartition(n, "src", "dst").groupBy("src", "dst").agg(F.max("unc").alias("uncertain"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as source files: (key, path); a package a brand, directories by type, endings by size."""
    kind, dot = F.col("p_size") % 9, F.lit(".ts")
    for k, e in enumerate((".test.ts", ".d.ts", ".md", ".json", ".py", ".png", "/Makefile", ".xyz")):
        dot = F.when(kind == k, e).otherwise(dot)
    dot = F.when(F.col("p_partkey") % 50 == 0, "/server.ts").otherwise(dot)
    brand, folder = F.lower(F.translate("p_brand", "#", "-")), F.translate(F.lower("p_type"), " ", "/")
    path = F.concat(F.lit("packages/"), brand, F.lit("/src/"), folder, F.lit("/p"), F.col("p_partkey").cast("string"), dot)
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), path.alias("path"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence on claims (one a user): kind, whether it contradicts."""
    kinds = F.element_at(F.array(*map(F.lit, EVIDENCE_KINDS)), (F.pmod(F.col("event_id"), F.lit(len(EVIDENCE_KINDS))) + 1).cast("int"))
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("claim_id"), kinds.alias("kind"), (F.col("event_id") % 97 == 0).alias("contradicts"), "ts")


EVIDENCE_KINDS = ["symbol_index_hit", "static_analysis_result", "tree_sitter_query", "source_span", "git_commit", "embedding_similarity", "llm_derivation", "test_result", "human_annotation"]
