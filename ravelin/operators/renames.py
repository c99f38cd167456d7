"""Files that moved: removed and added files of equal content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distance(a: str, b: str) -> float:
    """Edit distance over the longer length."""
    if a == b:
        return 0.0
    if not a or not b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] / max(len(a), len(b))


def assign(old: list[str], new: list[str], least: float) -> list[tuple[str, str, float]]:
    """Removed files in order of their paths take one added file each: the only one left, or that of the most similar name."""
    left, out = sorted(new), []
    for path in sorted(old):
        if not left:
            break
        name = path.rsplit("/", 1)[-1]
        far = [distance(name, p.rsplit("/", 1)[-1]) for p in left] if len(left) > 1 else [0.0]
        k = far.index(min(far))
        out.append((path, left.pop(k), max(least, 1.0 - far[k]) if len(far) > 1 else 1.0))
    return out


def detect(removed: DataFrame, added: DataFrame, least: float = 0.5) -> DataFrame:
    """(old_path, new_path, confidence) of (path, hash) tables. Files without a hash match nothing.

    One file on each side is a plain join. Only contents that several files share are
    assigned one after the other, a group a content.
    """
    r = removed.filter("hash is not null").groupBy("hash").agg(F.collect_list("path").alias("old"))
    a = added.filter("hash is not null").groupBy("hash").agg(F.collect_list("path").alias("new"))
    both = r.join(a, "hash")
    single = (F.size("old") == 1) & (F.size("new") == 1)
    sure = both.filter(single).select(F.col("old")[0].alias("old_path"), F.col("new")[0].alias("new_path"), F.lit(1.0).alias("confidence"))

    def run(batches):
        for batch in batches:
            rows = [x for o, n in zip(batch["old"], batch["new"], strict=True) for x in assign(list(o), list(n), least)]
            yield pd.DataFrame(rows, columns=["old_path", "new_path", "confidence"])

    return sure.unionByName(both.filter(~single).select("old", "new").mapInPandas(run, "old_path string, new_path string, confidence double"))
