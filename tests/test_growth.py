"""Steps whose memory or disk must not outgrow the input."""

from ravelin.operators import claims, graph, imports, ranges, rules
from ravelin.plans import engine
from ravelin.sources import tables as t


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_symbol_pairs_are_only_passed_on(spark):
    """n importers and n definers of a name make n * n pairs: no shuffle may see them."""
    n = 300
    i = spark.range(n).selectExpr("concat('i', id) as path", "'X' as name")
    s = spark.range(n).selectExpr("concat('s', id) as path", "'X' as name")
    out = imports.by_symbol(i, s)
    assert out.count() == n * n
    lines = plan(out).splitlines()
    made = [k for k, line in enumerate(lines) if "NOT (path" in line]  # where pairs are made
    assert len(made) == 1 and not any("Aggregate" in line or "Repartition" in line for line in lines[: made[0]])


def test_symbol_bands_with_own_null_and_repeated_definitions(spark):
    i = spark.createDataFrame([("a", "X"), ("a", "X"), ("b", "X"), ("c", "X"), (None, "X"), ("a", None), ("a", "Y"), ("a", "Z")], "path string, name string")
    s = spark.createDataFrame([("a", "X"), ("b", "X"), ("b", "X"), (None, "X"), ("b", "Y"), (None, "Y"), ("a", "Z"), ("b", None)], "path string, name string")
    assert rows(imports.by_symbol(i, s)) == [("a", "X", "b", "medium"), ("a", "Y", "b", "medium"), ("b", "X", "a", "medium"), ("c", "X", "a", "low"), ("c", "X", "b", "low")]


def test_import_edges_are_dealt_over_more_partitions_as_lineitem_grows(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    few = t.import_edges(spark, d)
    monkeypatch.setattr(ranges, "STORED", 2048)
    many = t.import_edges(spark, d)
    n = ranges.parts(t.load(spark, d, "lineitem"))
    assert n > 3 * few.rdd.getNumPartitions() and many.rdd.getNumPartitions() == n
    assert rows(many) == rows(few)


def test_searches_keep_no_pairs_in_memory(spark):
    """Edges for a breadth-first search aren't made distinct: it takes each node once anyway."""
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3)], "src long, dst long")
    assert "Aggregate" not in plan(graph.either_way(e))
    assert rows(graph.reach(graph.either_way(e), spark.createDataFrame([(1,)], "node long"))) == [(1, 0), (2, 1), (3, 2)]


def test_ends_of_imports_send_no_table_of_files_to_every_task(spark):
    d = "/root/testdata/sf0.001"
    ends = engine._ends(spark, d)
    assert "Broadcast" not in ends._jdf.queryExecution().executedPlan().toString()
    want = rules.joined(engine._links(spark, d).select("from_path", "to_path"), rules.membership(t.files(spark, d).select("path"), engine.BOUNDARIES))
    cols = ["from_path", "to_path", "from_boundary", "from_public", "to_boundary", "to_public"]
    assert sorted(map(str, ends.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_recipes_ask_for_edges_without_doubling_them(spark):
    """Pairs that are asked for are turned round, not all edges; either way round counts, an end that is missing doesn't."""
    kind = "import_edge_check"
    made = [(1, kind, 1, 2), (2, kind, 2, 1), (3, kind, 2, 3), (4, kind, None, 2), (5, kind, 2, None), (6, "shell", 1, 2), (7, kind, 4, 4), (8, kind, 1, 2)]
    r = spark.createDataFrame(made, "claim_id long, type string, from_id long, to_id long").selectExpr("*", "0 as place", "'s' as symbol", "'p' as path", "1 as start_line", "1 as end_line", "'the' as pattern")
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (4, 4), (2, 9)], "src long, dst long")
    out = claims.run_recipes(r, spark.createDataFrame([], "id string"), e, spark.createDataFrame([], "path string, content string"))
    assert rows(out.select("claim_id", "passed")) == [(1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, True), (8, True)]
    lines = plan(out).splitlines()
    assert sum("LeftSemi" in line for line in lines) == 1 and not any("Union" in line for line in lines)


def test_cochange_pairs_are_dealt_over_more_partitions_as_lineitem_grows(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    few = engine.cochange_evidence(spark, d)
    monkeypatch.setattr(ranges, "STORED", 2048)
    many = engine.cochange_evidence(spark, d)
    assert many.rdd.getNumPartitions() == 4 * ranges.parts(t.load(spark, d, "lineitem")) > few.rdd.getNumPartitions()
    assert rows(many) == rows(few)


def test_strong_components_take_their_nodes_from_trimmed_edges(spark, monkeypatch):
    """No turned copy of all edges is made; two cycles, a way between them, tails and a loop."""
    monkeypatch.setattr(graph, "both_ways", None)
    e = spark.createDataFrame([(9, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 7), (1, 2), (3, 3)], "src long, dst long")
    assert rows(graph.strong_components(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7)]
