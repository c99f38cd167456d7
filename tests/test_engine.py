"""The operations over a small model, rules as data, renames, flags and paths, against results worked out by hand or plainly."""

import random

import pytest
from pyspark.sql import functions as F
from ravelin import api
from ravelin.functions import classify
from ravelin.operators import claims as cl
from ravelin.operators import graph, ranges, renames, retrieval, rules


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, name, data):
    schema = api.SCHEMAS[name]
    columns = [c.strip().split(" ")[0] for c in split_top(schema)]
    return spark.createDataFrame([tuple(d.get(c) for c in columns) for d in data], schema)


def split_top(schema):
    out, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


@pytest.fixture
def store(spark):
    node = lambda i, kind, path=None, **k: {"id": i, "kind": kind, "stable_key": i, "display_name": i, "path": path, "language": "typescript" if path else None, "file_class": "source", "valid_from": "r1"} | k
    edge = lambda a, b, kind="imports", band="high", ep="static", **k: {"id": f"{kind}:{a}:{b}", "kind": kind, "src": a, "dst": b, "confidence_band": band, "epistemic": ep, "valid_from": "r1"} | k
    nodes = [node("repo", "repository"), node("sub", "subsystem"), *(node(x, "file", f"src/{x}.ts") for x in "abcd"), node("t", "file", "src/a.test.ts", file_class="test")]
    nodes += [node("s", "symbol", "src/a.ts", metadata='{"decorators":["app.route"]}'), node("a::vr0", "file", "old.ts", stable_key="a", valid_from="r0", valid_to="r1")]
    edges = [edge("a", "b"), edge("b", "c", band="low"), edge("c", "a"), edge("c", "d"), *(edge("sub", x, "contains") for x in ("a", "b", "t")), edge("repo", "sub", "contains"), edge("a", "d", "rename_candidate", metadata='{"confidence": 0.8}')]
    claim = lambda i, n, **k: {"id": i, "claim_type": "file-defines-symbols", "statement": i, "status": "hypothesis", "scope": '{"exported":true,"path":"src/a.ts"}', "confidence_band": "medium", "freshness_band": "fresh", "supporting": ["e1"], "generation_id": "g", "surfaced": True, "seq": n, "valid_from": "r1"} | k
    recipe = lambda **k: {c: k.get(c) for c in ("type", "symbol", "from_id", "to_id", "path", "start_line", "end_line", "pattern")}
    claims = [claim("claim::1", 1, recipes=[recipe(type="symbol_exists_check", symbol="a"), recipe(type="grep_check", path="src/a.ts", pattern="hello")]), claim("claim::2", 2, confidence_band="low", scope="no json"), claim("claim::3", 3, scope='{"subsystemId":"sub"}', recipes=[recipe(type="source_span_check", path="src/a.ts", start_line=1, end_line=9)])]
    text = [{"object_id": x, "object_type": "file", "text": f"{x}.ts src/{x}.ts", "path": f"src/{x}.ts"} for x in "abcd"] + [{"object_id": "s", "object_type": "symbol", "text": "Handler", "path": "src/a.ts"}]
    given = {"nodes": nodes, "edges": edges, "claims": claims, "text": text, "revisions": [{"id": "r1", "seq": 1}], "contents": [{"path": "src/a.ts", "content": "hello\nworld"}], "evidence": [{"id": "e1", "kind": "grep_hit"}], "partiality": [{"id": "p", "revision": "r1", "scope": "x", "extracted": [], "failed": ["f"]}]}
    return api.Store(spark, {n: table(spark, n, d) for n, d in given.items()}, [rules.Boundary("api", ["src/a.ts"], [], ["utils"]), rules.Boundary("db", ["src/b.ts"], ["src/none.ts"])], [rules.Rule("r", "no d", "src/c.ts", "src/d.ts")])


def test_state_and_overview(store):
    e = api.Engine(store)
    assert e.status().data == {"model_revision": "r1", "readiness": "ready", "has_partiality": True}
    assert dict(rows(e.doctor({"k": "sk-123456789012345", "n": "plain"}).data["tables"]))["edges"] == 9
    assert e.doctor({"k": "sk-123456789012345", "n": "plain"}).data["config"] == {"k": "[REDACTED]", "n": "plain"}
    o = e.overview("repo")
    assert o.data["totals"].first()["files"] == 3 and rows(o.partiality) == [("x", "degraded")]
    assert rows(o.data["boundary_coverage"]) == [(67,)] and e.overview("nothing").next_calls
    assert api.Engine(api.Store(store.spark)).status().data["readiness"] == "empty-model"


def test_lookup_falls_back_to_the_stable_key(store):
    assert store.node("a").first()["path"] == "src/a.ts" and store.node("a", "r0").first()["path"] == "old.ts" and store.node("b", "r0").isEmpty()


def test_graph_operations(store):
    e = api.Engine(store)
    b = e.blast_radius(["a", "zz"], 5)
    got = {r.node: (r.distance, r.via_uncertain) for r in b.data["affected"].collect()}
    assert got["a"][0] == 0 and got["b"] == (1, True) and got["c"] == (1, True) and got["d"][0] == 1 and [u["related"] for u in b.uncertainties] == [["zz"]]
    assert {r.id for r in b.data["risky_edges"].collect()} == {"imports:b:c"}
    t = e.trace_flow("a", "repo")
    assert [(r.src, r.dst, r.kind) for r in t.data["segments"].orderBy("step").collect()] == [("a", "sub", "contains"), ("sub", "repo", "contains")]
    assert e.trace_flow("a", "repo", edge_kinds=["imports"]).data["segments"].first()["unknown"] and e.trace_flow("none", "a").uncertainties
    g = e.import_graph("*", cycles=True)
    assert [r.node for r in g.data["cycles"].orderBy("place").collect()] == ["a", "b", "c", "a"] and g.data["metrics"].first()["total_edges"] == 4
    assert rows(e.import_graph("d", transitive=True).data["edges"]) == [] and rows(e.import_graph("a", transitive=True).data["edges"]) == [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    assert e.import_graph("nowhere").uncertainties
    s = e.explain_subsystem("sub").data
    assert rows(s["files"]) == [("src/a.test.ts",), ("src/a.ts",), ("src/b.ts",)] and rows(s["tests"]) == [("src/a.test.ts",)]


def test_finding(store):
    e = api.Engine(store)
    assert e.resolve_reference("src/b.ts").data["candidates"].first()[:2] == ("b", "path") and e.resolved("handler")[0] == "s" and e.resolve_reference("  ").data["status"] == "not_found"
    assert e.resolve_reference("claim::").data["status"] == "ambiguous" and e.resolve_reference("sub").data["candidates"].first()["strategy"] == "raw-id"
    found = e.find_entrypoints("Handler", hints=["app.*"]).data["candidates"]
    assert "s" in {r.id for r in found.collect()}
    with pytest.raises(TypeError):
        e.find_entrypoints("x", hints=[{"__proto__": 1}])


def test_claims_and_feedback(store):
    e = api.Engine(store)
    assert [r.id for r in e.list_claims().data["claims"].collect()] == ["claim::1", "claim::3"] and [r.id for r in e.list_claims(public_api_only=True).data["claims"].collect()] == ["claim::1"]
    kinds = [(r.kind, r.severity) for r in e.list_uncertainties().data["items"].collect()]
    assert ("rename-candidate", "medium") in kinds and ("static-only-uncorroborated", "medium") in kinds and ("low-confidence", "medium") in kinds
    v = e.verify_claim(["claim::1", "claim::3"], "r2").data["results"]
    got = {r.claim_id: (r.new_status, r.new_confidence) for r in v.collect()}
    assert got == {"claim::1": ("confirmed", "high"), "claim::3": ("contradicted", "low")}
    open_ = store.at("claims").select("id").collect()
    assert len(open_) == 3 and sum("-v-" in r.id for r in open_) == 2 and store["history"].count() == 2 and store.at("claims", "r1").count() == 3
    assert not e.claim_history("claim::1").data["verifications"].isEmpty()
    f = e.feedback(["claim::2", "gone"], "reject", "me", "r3", "no").data["results"]
    assert {(r.claim_id, r.new_status, r.evidence_appended) for r in f.collect()} == {("claim::2", "rejected", True), ("gone", "unknown", False)}
    assert store.latest() == "r3" and e.claim_history("claim::2").data["annotations"].count() == 1
    e.create_claim("note", "it is so", "{}", "me", "r4")
    assert e.list_claims(claim_type="note", include_low_value=True).data["claims"].first()["confidence_band"] == "low"
    assert e.evidence_agreement().data["rate"].first()["sampled"] == 4
    assert rows(e.compare_revisions("r0", "r1").data["file"])[0] == ("b", "added") and e.compare_revisions("r0", "r1").data["renames"].first()["confidence"] == 0.8


def test_invariants(store):
    got = rows(api.Engine(store).check_invariants().data["violations"].select("rule_id", "from_path", "to_path"))
    assert got == [("boundary:api:disallowed-dep:db", "src/a.ts", "src/b.ts"), ("boundary:db:non-public-import", "src/a.ts", "src/b.ts"), ("r", "src/c.ts", "src/d.ts")]
    assert api.Engine(store).check_invariants("src/d").data["violations"].count() == 1
    with pytest.raises(ValueError):
        rules.enforceable([rules.Rule("x", "x", "**", "**", status="inferred_candidate", origin="inferred")])


def test_rule_book():
    b = api.RuleBook()
    assert b.add("x", "a/**", "b/**", "forbidden_import")[0] and not b.add("x")[0] and not b.add("")[0] and not b.remove("y")[0] and b.switch("x", False)[0]
    assert b.explicit("r") == [] and b.listed()[0]["status"] == "disabled"
    out = b.exported("now")
    fresh = api.RuleBook()
    assert fresh.imported(out) == {"imported": 1, "skipped": 0, "rejected": []} and fresh.imported(out)["skipped"] == 1
    assert fresh.imported({"version": 1, "rules": [1, {"name": "z"}]})["rejected"] == [{"index": 0, "reason": "Not an object"}, {"index": 1, "reason": "Missing or invalid type"}]
    assert "Unsupported" in fresh.imported({"version": 2, "rules": []})["rejected"][0]["reason"] and [a["action"] for a in b.audit] == ["add", "disable"]


def test_renames_claim_each_file_once(spark):
    old = spark.createDataFrame([("a/x.ts", "h"), ("b/y.ts", "h"), ("c", "k"), ("d", None), ("e", "m"), ("f", "m")], "path string, hash string")
    new = spark.createDataFrame([("n/y.ts", "h"), ("n/x.ts", "h"), ("q", "k"), ("r", None), ("s", "m")], "path string, hash string")
    assert rows(renames.detect(old, new)) == [("a/x.ts", "n/x.ts", 1.0), ("b/y.ts", "n/y.ts", 1.0), ("c", "q", 1.0), ("e", "s", 1.0)]
    assert renames.assign(["longname"], ["q", "z"], 0.5) == [("longname", "q", 0.5)]


def plain_blast(edges, seeds, depth):
    seen, queue = {s: [0, False] for s in seeds}, [(s, 0, False) for s in seeds]
    for n, d, via in queue:
        if d >= depth:
            continue
        for i, a, b, unc in sorted((e for e in edges if n in e[1:3]), key=lambda e: (e[1], e[2], e[0])):
            to = a if b == n else b
            if to in seen:
                seen[to][1] |= via or unc
            else:
                seen[to] = [d + 1, via or unc]
                queue.append((to, d + 1, via or unc))
    return {n: tuple(v) for n, v in seen.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_blast_flags_are_the_plain_ones(spark, seed):
    r = random.Random(seed)
    made = [(f"e{k:03}", f"n{r.randrange(30):02}", f"n{r.randrange(30):02}", r.random() < 0.3) for k in range(60)]
    df = spark.createDataFrame([(i, "imports", a, b, u) for i, a, b, u in made], "id string, kind string, src string, dst string, uncertain boolean")
    got = {x.node: (x.distance, x.via_uncertain) for x in graph.blast(df, spark.createDataFrame([("n01",), ("n02",)], "node string"), 3).collect()}
    assert got == plain_blast(made, ["n01", "n02"], 3)


def test_trace_and_cycles(spark):
    e = lambda pairs: spark.createDataFrame([(f"{a}{b}", "imports", a, b) for a, b in pairs], "id string, kind string, src string, dst string")
    five = e(["AB", "BC", "CD", "DE", "EA"])
    goal = lambda x: spark.createDataFrame([(x,)], "node string")
    assert [(r.src, r.dst) for r in graph.trace(five, "A", goal("C")).orderBy("step").collect()] == [("A", "B"), ("B", "C")]
    assert graph.trace(five, "A", goal("A")).isEmpty() and graph.trace(five, "A", goal("C"), max_depth=1).isEmpty()
    tangle = e(["AB", "BA", "BC", "CD", "DB", "XX", "YZ"]).select("src", "dst")
    got = graph.cycle_paths(tangle, graph.strong_components(tangle)).orderBy("component", "place").collect()
    ways = {c: [r.node for r in got if r.component == c] for c in {r.component for r in got}}
    assert ways == {"A": ["A", "B", "A"], "X": ["X", "X"]}


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    assert rows(ranges.numbered(df, ["k"], "n").filter("n <> k + 1")) == []


def test_files_and_values(spark):
    df = spark.createDataFrame([("a/b.test.ts",), ("test/x.py",), ("lib/test/x.py",), ("x/dist/a.js",), ("Makefile",), ("a/readme.md",), ("i.png",), ("m.rs",), ("d.json",), (".gitignore",), ("z",)], "p string")
    assert [r[0] for r in df.select(classify.file_class(F.col("p"))).collect()] == ["test", "source", "test", "generated", "config", "doc", "asset", "source", "config", "config", "other"]
    w = spark.createDataFrame([("sk-aaaaaaaaaaaa",), ("short",), ("my_password=abcdefg",), ("a" * 30,), ("hello world, my friend",), (None,)], "v string")
    assert [r[0] for r in w.select(classify.looks_secret(F.col("v"))).collect()] == [True, False, True, True, False, False]
    assert spark.range(1).select(classify.token_ids(F.lit("Hi, hi!"))).first()[0] == [101, 4329, 4329, 102]
    up = spark.range(1).select(classify.relative_to(F.lit("a/c/d"), F.lit("a/b/e")), classify.extname(F.lit(".env")), classify.extname(F.lit("x/a.b.ts"))).first()
    assert tuple(up) == ("../../c/d", "", ".ts")


def test_phrases_without_accents(spark):
    df = spark.createDataFrame([(1, "Un Café bar", "x"), (2, "none", "a/cafe/bar"), (3, "cafebar", "y")], "id long, text string, path string")
    assert {r.id for r in retrieval.phrase(df, "cafe BAR", "text", "path").collect()} == {1, 2} and {r.id for r in retrieval.phrase(df, "CAFÉ bar").collect()} == {1}


def test_claims_of_files(spark):
    s = spark.createDataFrame([("packages/a/x.ts", "f", True, 2), ("packages/a/x.ts", "e", False, 1), ("y.ts", "g", False, 1)], "path string, name string, exported boolean, place long")
    got = {r.id: (r.statement, r.confidence_band, r.surfaced) for r in cl.file_symbols(s, "r").collect()}
    assert got["claim::file::r::packages/a/x.ts::defines"] == ("File packages/a/x.ts defines symbols: e, f", "high", True) and got["claim::file::r::y.ts::defines"][1] == "medium"
