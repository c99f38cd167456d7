"""Interval versions: as-of reads, version chains, differences, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(rev, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Visible at a revision; without one: still open."""
    if rev is None:
        return F.col(valid_to).isNull()
    return (F.col(valid_from) <= rev) & (F.col(valid_to).isNull() | (F.col(valid_to) > rev))


def versions(log: DataFrame, key: list[str], order: list[str], compare: list[str]) -> DataFrame:
    """Slowly changing rows: runs of equal `compare` values become [valid_from, valid_to) intervals."""
    w = Window.partitionBy(*key).orderBy(*order)
    same = F.lit(True)
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    starts = log.withColumn("__start", first | ~same).filter("__start").drop("__start")
    return starts.withColumn("valid_from", F.col(order[0])).withColumn("valid_to", F.lead(order[0]).over(w))


def upsert(old: DataFrame, new: DataFrame, key: str, compare: list[str], rev: str) -> DataFrame:
    """Versioned upsert: a changed row closes at `rev` under the id of its history row, the live row advances."""
    n = new.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in compare])
    j = old.filter("valid_to is null").join(n, F.col(key) == F.col("__k"), "full_outer")
    changed = F.lit(False)
    for c in compare:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = F.col(key).isNotNull() & F.col("__k").isNotNull()
    history = j.filter(both & changed).select(F.concat(key, F.lit("::v"), "valid_from").alias(key), *compare, "valid_from", F.lit(rev).alias("valid_to"))
    live = j.select(
        F.coalesce(key, "__k").alias(key),
        *[F.when(F.col("__k").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in compare],
        F.when(both & ~changed | F.col("__k").isNull(), F.col("valid_from")).otherwise(F.lit(rev)).alias("valid_from"),
        F.lit(None).cast("string").alias("valid_to"),
    )
    closed = old.filter("valid_to is not null").select(key, *compare, "valid_from", "valid_to")
    return closed.unionByName(history).unionByName(live)


def difference(df: DataFrame, key: str, a, b) -> DataFrame:
    """Keys visible at exactly one of two revisions, and the side."""
    seen = df.select(key, visible(a).alias("in_a"), visible(b).alias("in_b")).groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return seen.filter("in_a <> in_b").select(key, F.when(F.col("in_b"), "added").otherwise("removed").alias("change"))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(old.columns))


def replace_latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def hash_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) of two (path, hash) tables: added, changed, unchanged, removed."""
    s, c = stored.select("path", F.col("hash").alias("sh")), current.select("path", F.col("hash").alias("ch"))
    kind = F.when(F.col("sh").isNull(), "added").when(F.col("ch").isNull(), "removed").when(F.col("sh") == F.col("ch"), "unchanged").otherwise("changed")
    return s.join(c, "path", "full_outer").select("path", kind.alias("change"))
