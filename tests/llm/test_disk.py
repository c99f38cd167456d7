"""Disk that a query holds while it runs: shuffle files and tables of steps that are done."""

import os
import random
from pathlib import Path

from ravelin.llm import ngram_join, substring_dedup


def shuffled(spark):
    """Bytes of the shuffle files on disk, by name."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getPath() for i in range(files.size())]
    return {f: os.path.getsize(f) for f in names if Path(f).name.startswith("shuffle_") and os.path.exists(f)}


def tables(spark):
    """Bytes of the tables in the shared folder."""
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return sum(p.stat().st_size for p in base.glob("scratch-*/**/*.parquet"))


def corpus(spark, rows=300):
    r = random.Random(3)
    v = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    texts = [[r.choice(v) for _ in range(120)] for _ in range(rows)]
    texts += [t[: r.randrange(60, 120)] + ["x"] for t in texts[::2]] + [[*t[:50], "y", *t[51:]] for t in texts[::3]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string"), sum(len(t) for _, t in rows)


def left_by(spark, make):
    before = shuffled(spark)
    out = make()
    return out, sum(n for f, n in shuffled(spark).items() if f not in before)


def test_substring_dedup_holds_one_step_at_a_time(spark):
    """Of the steps before the automata only tables are left, and the last step shuffles the texts and passages only."""
    docs, size = corpus(spark)
    out, left = left_by(spark, lambda: substring_dedup.remove_repeats(docs, 20))
    assert left < size / 20
    assert out._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow") == 1


def test_ngram_join_holds_one_step_at_a_time(spark):
    """No shuffle files of the steps are left, and of their tables only what the result reads."""
    docs, size = corpus(spark)
    had = tables(spark)
    out, left = left_by(spark, lambda: ngram_join.join_components(docs, 4, 85, 100))
    assert left < size / 5
    names = {Path(f).parent for f in out.inputFiles()}
    kept = sum(p.stat().st_size for d in names for p in Path(str(d).removeprefix("file:")).glob("*.parquet"))
    assert tables(spark) - had < kept + size / 20
