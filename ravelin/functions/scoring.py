"""The scoring algebra as column expressions: bands, freshness, status, surfacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ["none", "low", "medium", "high"]
FRESHNESS = ["stale", "aging", "fresh"]
# Ranks of evidence kinds.
RANKS = {
    "human_annotation": 8, "test_result": 7, "runtime_trace": 7, "symbol_index_hit": 6, "static_analysis_result": 5, "tree_sitter_query": 4,
    "grep_hit": 3, "source_span": 3, "git_commit": 2, "embedding_similarity": 1, "llm_derivation": 0,
}
# Category and importance by claim type.
CLASSES = {
    "likely-entrypoint": ("entrypoint", "high"), "package-imports-package": ("import", "medium"), "directory-derived-subsystem-hypothesis": ("subsystem", "medium"),
    "subsystem-owns-file": ("subsystem", "medium"), "forbidden-import-violation": ("invariant", "high"),
}
IMPORTANCE = ["low", "medium", "high"]


def rank(kind: Column) -> Column:
    out = F.lit(0)
    for k, v in RANKS.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def ordinal(band: Column, names: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), band) - 1


def named(i: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))


def fold_evidence(evidence: DataFrame, claim: str = "claim_id") -> DataFrame:
    """One pass per claim: everything that confidence, status and surfacing need.

    Contradicting rows only count as contradictions; all other numbers are of the
    supporting rows.
    """
    support = ~F.coalesce("contradicts", F.lit(False))
    solid = support & (F.col("kind") != "llm_derivation")
    return evidence.groupBy(claim).agg(
        F.count_if(support).alias("n_evidence"),
        F.max(F.when(support, rank(F.col("kind")))).alias("top_rank"),
        F.count_if(solid).alias("n_solid"),
        F.count_distinct(F.when(solid, F.col("kind"))).alias("n_solid_kinds"),
        F.count_if(support & (F.col("kind") == "human_annotation")).alias("n_human"),
        F.count_if("contradicts").alias("n_contra"),
    )


def confidence(freshness: Column) -> Column:
    """Index of the band, over the columns of `fold_evidence`."""
    base = F.when(F.col("top_rank") >= 6, 3).when(F.col("top_rank") >= 4, 2).otherwise(1)
    up = (F.col("n_solid") >= 2).cast("int") + (F.col("n_solid_kinds") >= 2).cast("int") + (F.col("n_human") > 0).cast("int")
    down = F.when(F.col("n_contra") > 0, 2).otherwise(0) + F.when(freshness == "stale", 2).when(freshness == "aging", 1).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(3), base + up) - down)
    score = F.when(F.col("n_solid") == 0, F.least(F.lit(2), score)).otherwise(score)
    return F.when(F.col("n_evidence") == 0, 0).otherwise(score).cast("int")


def step_down(freshness: Column, touched: Column, same_revision: Column | None = None) -> Column:
    """One step lower where a change touches the scope, unless the evidence is of the change's own revision."""
    if same_revision is not None:
        touched = touched & ~F.coalesce(same_revision, F.lit(False))
    return F.when(touched, named(F.greatest(F.lit(0), ordinal(freshness, FRESHNESS) - 1), FRESHNESS)).otherwise(freshness)


def next_status(prior: Column) -> Column:
    return F.when(F.col("n_contra") > 0, "contradicted").when(prior == "rejected", "rejected").when((F.col("n_human") > 0) | (F.col("n_solid") > 0), "confirmed").otherwise("hypothesis")


def surfaceable(recipes: Column) -> Column:
    """Over the columns of `fold_evidence` and `band_no`: supported, verifiable, not by language models alone, medium or more."""
    return (F.col("n_evidence") >= 1) & (recipes >= 1) & (F.col("n_solid") >= 1) & (F.col("band_no") >= 2)


def surfacing_class(claim_type: Column, exported: Column) -> tuple[Column, Column]:
    """(category, importance) of a claim."""
    out = [F.lit("other"), F.lit("low")]
    for name, found in CLASSES.items():
        out = [F.when(claim_type == name, v).otherwise(o) for v, o in zip(found, out, strict=True)]
    symbols = claim_type.isin("file-defines-symbol", "file-defines-symbols")
    shown = F.coalesce(exported, F.lit(False))
    for i, (yes, no) in enumerate((("exported-symbol", "local-symbol"), ("high", "low"))):
        out[i] = F.when(symbols, F.when(shown, yes).otherwise(no)).otherwise(out[i])
    return out[0], out[1]


def importance_at_least(importance: Column, least: str) -> Column:
    return ordinal(importance, IMPORTANCE) >= IMPORTANCE.index(least)
