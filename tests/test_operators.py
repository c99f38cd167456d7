from pyspark.sql import functions as F
from ravelin.functions import paths, scoring
from ravelin.operators import graph, retrieval, temporal


def edges(spark, pairs):
    return spark.createDataFrame([(f"e{i}", a, b) for i, (a, b) in enumerate(pairs)], "id string, src string, dst string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bow_tie_terminates_on_a_cycle(spark):
    got = graph.bow_tie(edges(spark, ["AB", "BC", "CA"]), "A", 5)
    assert {r.id for r in got.collect()} == {"e0", "e1", "e2"}
    assert got.count() == got.distinct().count()


def test_reach_and_depth_bound(spark):
    e = edges(spark, ["AB", "BC", "CD", "DE", "EA"])
    seeds = spark.createDataFrame([("A",)], "node string")
    assert rows(graph.reach(e, seeds, 3)) == [("A", 0), ("B", 1), ("C", 2), ("D", 3)]
    assert graph.reach(e, seeds).count() == 5


def test_fan(spark):
    assert rows(graph.fan(edges(spark, ["AB", "AC", "DB"]))) == [("A", 0, 2), ("B", 2, 0), ("C", 1, 0), ("D", 0, 1)]


def test_strong_components(spark):
    got = rows(graph.strong_components(edges(spark, ["AB", "BC", "CA", "CD", "DE", "ED", "FF", "EG"])))
    assert got == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "D"), ("E", "D"), ("F", "F")]


def test_components(spark):
    assert rows(graph.components(edges(spark, ["AB", "CB", "DE"]))) == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "D"), ("E", "D")]


def test_upsert_keeps_history(spark):
    old = spark.createDataFrame([("n", "a.ts", "r1", None), ("m", "x", "r1", None)], "id string, path string, valid_from string, valid_to string")
    new = spark.createDataFrame([("n", "b.ts"), ("k", "y")], "id string, path string")
    got = rows(temporal.upsert(old, new, "id", ["path"], "r2"))
    assert got == [("k", "y", "r2", None), ("m", "x", "r1", None), ("n", "b.ts", "r2", None), ("n::vr1", "a.ts", "r1", "r2")]


def test_cosine_order(spark):
    v = [(1, [1.0, 0.0, 0.0]), (2, [0.7, 0.7, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.5, 0.5, 0.5]), (5, [0.9, 0.1, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in retrieval.top_k(df, [1, 0, 0], 5).collect()] == [1, 5, 2, 4, 3]


def test_phrase_operators_are_words(spark):
    df = spark.createDataFrame([(1, "export function processQueue"), (2, "export function processItem")], "id long, text string")
    assert [r.id for r in retrieval.phrase(df, "processQueue").collect()] == [1]
    assert retrieval.phrase(df, "export OR processItem").count() == 0


def test_confidence(spark):
    ev = [(1, "llm_derivation", False), (2, "symbol_index_hit", False), (2, "grep_hit", True), (3, "git_commit", False), (3, "grep_hit", False), (4, "human_annotation", False), (5, "symbol_index_hit", True), (5, "tree_sitter_query", False), (6, "grep_hit", True)]
    df = scoring.fold_evidence(spark.createDataFrame(ev, "claim_id long, kind string, contradicts boolean"))
    got = dict(df.select("claim_id", scoring.confidence(F.lit("fresh"))).collect())
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 0, 6: 0}


def test_globs():
    import re

    m = lambda g, p: bool(re.search(paths.glob_regex(g), p))
    assert m("src/*.ts", "src/a.ts") and not m("src/*.ts", "src/b/a.ts")
    assert m("src/**/*.ts", "src/b/a.ts") and m("src/**/*.ts", "src/a.ts") and m("*.{js,ts}", "x.js")


def test_catalog_has_a_twin_for_each_query():
    from ravelin.plans import catalog

    assert set(catalog.queries()) == set(catalog.oracle_sql())
