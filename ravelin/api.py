"""The operations of the engine over a store of tables, each answered in an envelope.

A `Store` holds the tables of one model; `Engine` has one method per operation. Results
stay tables: an envelope's `data` maps names to DataFrames or to small values. Only
counts and single rows come to the driver, for hints on what to ask next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify, scoring
from .operators import claims as cl
from .operators import graph, retrieval, rules, temporal

# Keys that no argument may have.
FORBIDDEN_KEYS = {"__proto__", "constructor", "prototype"}
BLAST_DEPTH, TRACE_DEPTH, MAX_CYCLES, MANY = 5, 10, 100, 20

SCHEMAS = {
    "revisions": "id string, repository_id string, kind string, parent_id string, seq long",
    "nodes": "id string, kind string, stable_key string, display_name string, path string, language string, file_class string, metadata string, valid_from string, valid_to string",
    "edges": "id string, kind string, src string, dst string, confidence_band string, epistemic string, evidence_ids array<string>, metadata string, valid_from string, valid_to string",
    "evidence": "id string, kind string, epistemic string, revision string, path string, actor string, metadata string",
    "claims": "id string, claim_type string, statement string, status string, scope string, confidence_band string, freshness_band string, supporting array<string>, contradicting array<string>, "
    "recipes array<struct<type:string,symbol:string,from_id:string,to_id:string,path:string,start_line:int,end_line:int,pattern:string>>, generation_id string, surfaced boolean, seq long, valid_from string, valid_to string",
    "history": "id string, claim_id string, prior_status string, new_status string, prior_confidence string, new_confidence string, ran_at string",
    "partiality": "id string, revision string, scope string, extracted array<string>, failed array<string>, skipped array<string>",
    "text": "object_id string, object_type string, text string, path string",
    "embeddings": "node_id string, model_name string, vector array<float>",
    "contents": "path string, content string",
    "file_hashes": "path string, hash string",
}


@dataclass
class Envelope:
    op: str
    args: dict[str, Any]
    data: dict[str, Any]
    revision: str = "latest"
    evidence: DataFrame | None = None
    uncertainties: list[dict] = field(default_factory=list)
    next_calls: list[dict] = field(default_factory=list)
    partiality: DataFrame | None = None

    def __post_init__(self):
        if not self.op or not isinstance(self.args, dict) or not isinstance(self.data, dict) or not self.revision:
            raise TypeError("an envelope needs an operation, arguments, data and a revision")


def guard(value: Any, at: str = "$") -> None:
    """Arguments are plain values: no functions and no keys that reach into objects."""
    if callable(value):
        raise TypeError(f"Untrusted input contains a function at {at}")
    if isinstance(value, dict):
        for k, v in value.items():
            if k in FORBIDDEN_KEYS:
                raise TypeError(f'Untrusted input contains prohibited key "{k}" at {at}.{k}')
            guard(v, f"{at}.{k}")
    elif isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            guard(v, f"{at}[{i}]")


def tagged(lines: DataFrame) -> DataFrame:
    """Text lines with what backs them. lines: text, evidence_id, claim_id, hypothesis."""
    tag = F.when(F.col("evidence_id").isNotNull(), F.concat(F.lit("[evidence:"), "evidence_id", F.lit("]"))).when(F.col("claim_id").isNotNull(), F.concat(F.lit("[claim:"), "claim_id", F.lit("]")))
    tag = tag.when(F.coalesce("hypothesis", F.lit(False)), "[hypothesis]").otherwise("[trivial]")
    return lines.select(F.concat(tag, F.lit(" "), "text").alias("line"))


class Store:
    """The tables of a model; those that aren't given are empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, boundaries: list[rules.Boundary] | None = None, rule_book: list[rules.Rule] | None = None):
        self.spark = spark
        unknown = set(tables or {}) - set(SCHEMAS)
        if unknown:
            raise KeyError(f"no such tables: {sorted(unknown)}")
        self.tables = {n: (tables or {}).get(n) if n in (tables or {}) else spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
        self.boundaries, self.rules = boundaries or [], rule_book or []

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def at(self, name: str, revision: str | None = None) -> DataFrame:
        return self.tables[name].filter(temporal.visible(None if revision in (None, "latest") else F.lit(revision)))

    def node(self, node_id: str, revision: str | None = None) -> DataFrame:
        """The node; at a revision that doesn't have it, the row with its stable key that was visible then."""
        if revision in (None, "latest"):
            return self.at("nodes").filter(F.col("id") == node_id)
        seen = self.at("nodes", revision)
        key = self["nodes"].filter(F.col("id") == node_id).select("stable_key").distinct()
        both = seen.filter(F.col("id") == node_id).withColumn("__o", F.lit(0)).unionByName(seen.join(key, "stable_key", "left_semi").withColumn("__o", F.lit(1)))
        return both.orderBy("__o", "id").limit(1).drop("__o")

    def claim(self, claim_id: str, revision: str | None = None) -> DataFrame:
        return self.at("claims", revision).filter(F.col("id") == claim_id)

    def evidence_of(self, claim: DataFrame) -> DataFrame:
        ids = claim.select(F.explode(F.concat("supporting", F.coalesce("contradicting", F.array().cast("array<string>")))).alias("id"))
        return self["evidence"].join(ids.distinct(), "id", "left_semi")

    def latest(self) -> str:
        row = self["revisions"].agg(F.max_by("id", "seq")).first()
        return row[0] or ""

    def imports(self, revision: str | None = None) -> DataFrame:
        return self.at("edges", revision).filter("kind = 'imports'").select("id", "kind", "src", "dst", unsure().alias("uncertain"))

    def import_paths(self) -> DataFrame:
        n = self.at("nodes").filter("path is not null")
        e = self.imports()
        return e.join(n.select(F.col("id").alias("src"), F.col("path").alias("from_path")), "src").join(n.select(F.col("id").alias("dst"), F.col("path").alias("to_path")), "dst").select("from_path", "to_path")


def unsure():
    """An edge of low or no confidence, or inferred; one without a band is medium, one without a kind of knowledge inferred."""
    return F.coalesce("confidence_band", F.lit("medium")).isin("low", "none") | (F.coalesce("epistemic", F.lit("inferred")) == "inferred")


def missing(node: str, severity: str, action: str) -> dict:
    return {"id": f"uncertainty:missing:{node}", "kind": "low-confidence", "severity": severity, "description": f'"{node}" not found in model', "related": [node], "action": action}


def call(op: str, reason: str, **args) -> dict:
    return {"op": op, "args": args, "reason": reason}


class Engine:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    # -- the state of the model --

    def status(self) -> Envelope:
        revision = self.store.latest()
        partial = not self.store["partiality"].isEmpty()
        data = {"model_revision": revision, "readiness": "ready" if revision else "empty-model", "has_partiality": partial if revision else False}
        return Envelope("status", {}, data, revision or "none")

    def doctor(self, config: dict[str, str] | None = None) -> Envelope:
        """Counts of all tables in one pass each, ends of edges that have no node, and the configuration without secrets."""
        counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in self.store.tables.items()])
        ends = self.store.at("edges").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        dangling = ends.join(self.store.at("nodes").select("id"), "id", "left_anti")
        shown = self.spark.createDataFrame([(config or {},)], "config map<string,string>").select(classify.redacted(F.col("config")).alias("config")).first()[0]
        return Envelope("doctor", {}, {"tables": counts, "dangling": dangling, "config": shown}, self.store.latest() or "none")

    def overview(self, root: str, revision: str | None = None) -> Envelope:
        if self.store.node(root, revision).isEmpty():
            return Envelope("getRepositoryOverview", {"repo": root}, {"inside": self.store["nodes"].limit(0)}, revision or "latest", next_calls=[call("index", "No repository node found; indexing may be needed")])
        inside = self._inside(root, revision)
        sums = inside.agg(
            F.array_sort(F.collect_set("language")).alias("languages"), F.count_if(F.col("kind") == "directory").alias("directories"), F.count_if(F.col("kind") == "file").alias("files"),
            F.count_if((F.col("kind") == "file") & (F.col("file_class") == "entrypoint")).alias("entrypoints"),
        )
        members = rules.membership(inside.filter("kind = 'file'").select("path"), self.store.boundaries)
        covered = members.agg(F.floor(100.0 * F.count("boundary") / F.greatest(F.count("*"), F.lit(1)) + 0.5).cast("long").alias("percent"))
        data = {"totals": sums, "subsystems": inside.filter("kind = 'subsystem'").select("id", "display_name"), "inside": inside, "boundary_coverage": covered}
        return Envelope("getRepositoryOverview", {"repo": root}, data, revision or "latest", partiality=self._partiality(revision))

    def _inside(self, root: str, revision: str | None = None) -> DataFrame:
        e = self.store.at("edges", revision).filter("kind in ('contains', 'owns')").select("src", "dst")
        below = graph.reach(e, self.spark.createDataFrame([(root,)], "node string")).filter("depth > 0")
        return self.store.at("nodes", revision).join(below.select(F.col("node").alias("id")), "id", "left_semi")

    def _partiality(self, revision: str | None) -> DataFrame:
        """One row per scope: none, partial (something failed or was skipped) or degraded (nothing was extracted)."""
        n = lambda c: F.coalesce(F.size(c), F.lit(0))
        p = self.store["partiality"].filter(F.col("revision") == (revision or self.store.latest()))
        bad = (n("failed") > 0) | (n("skipped") > 0)
        return p.select("scope", F.when(bad & (n("extracted") == 0), "degraded").when(bad, "partial").otherwise("none").alias("state"))

    # -- finding things --

    def _anchors(self, text: str | None, nodes: list[str], revision: str | None, vector: list[float] | None = None) -> DataFrame:
        given = self.store.at("nodes", revision).filter(F.col("id").isin(*nodes)).select("id") if nodes else self.store["nodes"].limit(0).select("id")
        hits = self.search(text or "", revision).select("id", "bm25")
        near = self.similar(vector, retrieval.SEMANTIC_LIMIT, revision) if vector else self.spark.createDataFrame([], "id string, score double")
        return retrieval.pipeline(given, hits, near, self.store.at("edges", revision).select("id", "src", "dst"), self.store.at("claims", revision).select("id"))

    def search(self, text: str, revision: str | None = None) -> DataFrame:
        """(id, object_type, text, path, bm25) of indexed nodes that are visible and hold the phrase in text or path."""
        seen = self.store["text"].join(self.store.at("nodes", revision).select(F.col("id").alias("object_id")), "object_id", "left_semi")
        hits = retrieval.phrase(seen, text, "text", "path").withColumnRenamed("object_id", "id")
        terms = retrieval.terms_of(text)
        if not terms:
            return hits.withColumn("bm25", F.lit(0.0))
        score = retrieval.bm25(seen.select("object_id", F.concat_ws(" ", "text", "path").alias("text")), terms, "object_id").withColumnRenamed("doc_id", "id")
        return hits.join(score, "id", "left").select("id", "object_type", "text", "path", F.coalesce("score", F.lit(0.0)).alias("bm25"))

    def similar(self, vector: list[float], limit: int = 10, revision: str | None = None) -> DataFrame:
        seen = self.store["embeddings"].join(self.store.at("nodes", revision).select(F.col("id").alias("node_id")), "node_id", "left_semi")
        return retrieval.top_k(seen, vector, limit, "node_id", "vector").withColumnRenamed("node_id", "id")

    def find_entrypoints(self, query: str, limit: int = retrieval.ENTRYPOINTS, hints: list[str] | None = None, revision: str | None = None) -> Envelope:
        guard({"query": query, "limit": limit, "hints": hints})
        nodes = self.store.at("nodes", revision)
        fits: Callable = lambda d: reduce(lambda a, b: a | b, [classify.hint_matches(h, d) for h in hints or []], F.lit(False))
        decorated = nodes.filter("kind = 'symbol'").filter(F.exists(classify.decorator_names(F.col("metadata")), fits)).select("id")
        claims = self.store.at("claims", revision).select("id", "claim_type", F.get_json_object("scope", "$.path").alias("path"))
        found = retrieval.entrypoints(claims, self._anchors(query, [], revision), nodes, decorated, limit)
        none = [missing(query, "low", "Try another query or index more files")] if query and found.isEmpty() else []
        return Envelope("findEntrypoints", {"query": query, "limit": limit}, {"candidates": found}, revision or "latest", uncertainties=none)

    def resolve_reference(self, asked: str, hint: str | None = None) -> Envelope:
        guard({"input": asked, "hint": hint})
        found = retrieval.resolve_reference(asked, self.store.at("nodes").select("id", "kind"), self.store.at("claims").select("id"), self.store["text"], hint)
        status = found.select("status").first()
        return Envelope("resolveReference", {"input": asked, "hint": hint}, {"status": status[0] if status else "not_found", "candidates": found})

    def resolved(self, asked: str) -> tuple[str | None, Envelope]:
        """The one id that a reference means, or none and why."""
        e = self.resolve_reference(asked)
        row = e.data["candidates"].select("id").first() if e.data["status"] == "resolved" else None
        return (row[0] if row else None), e

    # -- graph --

    def trace_flow(self, start: str, target: str, max_depth: int = TRACE_DEPTH, edge_kinds: list[str] | None = None, revision: str | None = None) -> Envelope:
        guard({"start": start, "target": target, "kinds": edge_kinds})
        args = {"start": start, "targetOrIntent": target, "maxDepth": max_depth}
        steps = "step int, src string, dst string, kind string, id string, tag string, unknown boolean"
        if self.store.node(start, revision).isEmpty():
            return Envelope("traceFlow", args, {"segments": self.spark.createDataFrame([], steps)}, revision or "latest", uncertainties=[missing(start, "high", "Resolve the reference before tracing")], next_calls=[call("resolveReference", "Resolve the start reference", input=start)])
        direct = self.store.node(target, revision)
        goals = direct.select(F.col("id").alias("node")) if not direct.isEmpty() else self._anchors(target, [], revision).orderBy(F.desc("rank"), "id").limit(5).select(F.col("id").alias("node"))
        path = graph.trace(self.store.at("edges", revision).select("id", "kind", "src", "dst"), start, goals, max_depth, edge_kinds)
        if path.isEmpty():
            unknown = self.spark.createDataFrame([(1, start, target, "unknown", None, None, True)], steps)
            again = [call("findEntrypoints", "No path found; search for entrypoints matching the target", query=target), call("estimateBlastRadius", "No path found; estimate blast radius from the start node instead", changeScope=[start])]
            return Envelope("traceFlow", args, {"segments": unknown}, revision or "latest", uncertainties=[{"id": f"uncertainty:no-path:{start}:{target}", "kind": "weak-edges", "severity": "medium", "related": [start, target]}], next_calls=again)
        shown = path.withColumns({"tag": F.when(F.col("kind") == "event-flow", "[declared]"), "unknown": F.lit(False)})
        return Envelope("traceFlow", args, {"segments": shown}, revision or "latest", next_calls=[call("estimateBlastRadius", "Estimate impact of changes at the start node", changeScope=[start]), call("explainSubsystem", "Understand the subsystem containing the start node", subsystemId=start)])

    def blast_radius(self, scope: list[str], max_depth: int = BLAST_DEPTH, revision: str | None = None) -> Envelope:
        guard({"changeScope": scope})
        nodes = self.store.at("nodes", revision)
        there = {r.id for r in nodes.filter(F.col("id").isin(*scope)).select("id").collect()} if scope else set()  # the asked ids only
        seeds = self.spark.createDataFrame([(s,) for s in dict.fromkeys(scope) if s in there], "node string")
        edges = self.store.at("edges", revision).select("id", "kind", "src", "dst", unsure().alias("uncertain"))
        affected = graph.blast(edges, seeds, max_depth)
        risky = graph.risky(edges, affected.filter(F.col("distance") < max_depth).select("node"))
        n = affected.filter("distance > 0").count()
        if n == 0:
            calls = [call("resolveReference", "No affected nodes found; verify the change scope resolves correctly", input=(scope or [""])[0])]
        elif n > MANY:
            calls = [call("traceFlow", f"{n} affected nodes found; trace specific flow paths for targeted analysis", start=scope[0], targetOrIntent="downstream")]
        else:
            calls = [call("listUncertainties", "Review uncertainties that may affect blast radius accuracy"), call("traceFlow", "Trace specific flow paths from the change scope", start=scope[0], targetOrIntent="downstream")]
        gone = [missing(s, "medium", "Verify the node ID or re-index") for s in scope if s not in there]
        return Envelope("estimateBlastRadius", {"changeScope": scope, "maxDepth": max_depth}, {"affected": affected, "risky_edges": risky}, revision or "latest", uncertainties=gone, next_calls=calls)

    def import_graph(self, scope: str = "*", cycles: bool = False, transitive: bool = False, max_cycles: int = MAX_CYCLES) -> Envelope:
        guard({"scope": scope})
        every, nodes = self.store.imports(), self.store.at("nodes").select("id")
        edges = graph.scoped(every, scope, nodes)
        none = edges.isEmpty()
        if transitive and scope and scope != "*":
            exact = nodes.filter(F.col("id") == scope).select(F.col("id").alias("node"))
            seeds = exact if not exact.isEmpty() else edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
            edges = graph.between(every, graph.reach(every, seeds))
        fans = graph.fan(edges)
        data: dict[str, Any] = {"edges": edges.select("src", "dst").distinct(), "nodes": fans, "metrics": graph.metrics(edges)}
        if cycles:
            e = edges.select("src", "dst")
            found = graph.strong_components(e)
            heads = found.select("component").distinct().orderBy("component").limit(max_cycles)
            data["cycles"] = graph.cycle_paths(e, found).join(heads, "component", "left_semi")
            data["cycles_limit_reached"] = found.select("component").distinct().count() > max_cycles
        unc = [{"id": f"import-graph-empty-scope-{scope}", "kind": "empty-scope", "severity": "low", "related": []}] if none else []
        return Envelope("getImportGraph", {"scope": scope, "detectCycles": cycles, "transitiveDeps": transitive, "maxCycles": max_cycles}, data, uncertainties=unc, next_calls=[] if none or cycles else [call("getImportGraph", "Detect import cycles in this scope", scope=scope, detectCycles=True)])

    def explain_subsystem(self, subsystem: str, revision: str | None = None) -> Envelope:
        guard({"subsystemId": subsystem})
        found = self.store.node(subsystem, revision)
        files = self._inside(subsystem, revision).filter("kind = 'file'").select(F.coalesce("path", "id").alias("path"), "file_class")
        e = self.store.at("edges", revision)
        out = lambda kind: graph.bow_tie(e.filter(F.col("kind") == kind).select("id", "src", "dst"), subsystem, 2)
        far = F.when(F.col("dst") == subsystem, F.col("src")).otherwise(F.col("dst"))
        outward = out("imports").select(far.alias("node"), F.lit(False).alias("inward")).unionByName(out("depends_on").select(far.alias("node"), (F.col("dst") == subsystem).alias("inward")))
        outward = outward.filter(F.col("node") != subsystem).distinct()
        claim = self.store.claim(subsystem, revision)
        data = {
            "files": files.select("path"), "tests": files.filter("file_class = 'test'").select("path"), "inbound": outward.filter("inward").select("node"), "outbound": outward.filter("not inward").select("node"),
            "claims": claim.filter("status <> 'contradicted'").select("id", "claim_type", "statement"), "contradictions": claim.filter("status = 'contradicted'").select("id", "claim_type", "statement"),
        }
        unc = [missing(subsystem, "high", "Verify the subsystem ID or re-index")] if found.isEmpty() else []
        return Envelope("explainSubsystem", {"subsystemId": subsystem}, data, revision or "latest", uncertainties=unc)

    # -- claims --

    def list_claims(self, claim_type: str | None = None, status: str | None = None, include_low_value: bool = False, public_api_only: bool = False, revision: str | None = None) -> Envelope:
        guard({"claimType": claim_type, "status": status})
        c = self.store.at("claims", revision).withColumn("band_no", scoring.ordinal(F.col("confidence_band"), scoring.BANDS))
        c = c if claim_type is None else c.filter(F.col("claim_type") == claim_type)
        c = c if status is None else c.filter(F.col("status") == status)
        c = c if include_low_value else c.filter("band_no >= 2")
        c = c.filter(F.get_json_object("scope", "$.exported") == "true") if public_api_only else c
        return Envelope("listClaims", {"claimType": claim_type, "status": status}, {"claims": c.orderBy(F.desc("band_no"), "id").select("id", "claim_type", "statement", "status", "confidence_band", "freshness_band")}, revision or "latest")

    def list_uncertainties(self, min_severity: str = "low", scope: dict[str, str] | None = None, revision: str | None = None) -> Envelope:
        guard({"minSeverity": min_severity, "scope": scope})
        c, s = self.store.at("claims"), scope or {}
        c = c.filter(cl.scoped(F.col("scope"), s.get("repositoryId"), s.get("path"), s.get("subsystemId"))) if scope else c
        moved = self.store.at("edges").filter("kind = 'rename_candidate'").select("src", "dst")
        found = cl.uncertainties(c, moved, self.store["partiality"].filter(F.col("revision") == (revision or self.store.latest())), min_severity)
        calls = [call("listClaims", "View the full claim set including sub-threshold items", includeLowValue=True), call("getRepositoryOverview", "Get context on the overall model state")]
        n = found.count()
        if n > 10:
            calls.append(call("checkInvariants", f"{n} uncertainties found; check for architecture rule violations"))
        ordered = found.orderBy(F.desc(scoring.ordinal(F.col("severity"), scoring.IMPORTANCE)), "id")
        return Envelope("listUncertainties", {"minSeverity": min_severity, "scope": scope}, {"items": ordered}, revision or "latest", next_calls=calls)

    def claim_payload(self, claim_id: str, revision: str | None = None) -> Envelope:
        claim = self.store.claim(claim_id, revision)
        return Envelope("buildClaimPayload", {"claimId": claim_id}, {"claim": claim, "evidence": self.store.evidence_of(claim)}, revision or "latest")

    def claim_history(self, claim_id: str) -> Envelope:
        """Verifications in order, people's notes, and all claims of the same generation in the order they came."""
        mine = self.store["claims"].filter(F.col("id") == claim_id)
        chain = self.store["claims"].join(mine.select("generation_id").distinct(), "generation_id", "left_semi").orderBy("seq")
        notes = self.store["evidence"].filter((F.col("kind") == "human_annotation") & F.contains("metadata", F.lit(claim_id)))
        runs = self.store["history"].filter(F.col("claim_id") == claim_id).orderBy("ran_at", "id")
        return Envelope("getClaimHistory", {"claimId": claim_id}, {"claim": mine, "successors": chain, "annotations": notes, "verifications": runs})

    def evidence_agreement(self, sample: int = 10) -> Envelope:
        """A systematic sample of claims: the share without contradicting evidence."""
        c = self.store.at("claims").select("id", F.coalesce(F.size("contradicting"), F.lit(0)).alias("n"))
        step = max(1, c.count() // max(1, sample))
        picked = graph.ranges.numbered(c, ["id"], "i").filter(((F.col("i") - 1) % step == 0) & (F.col("i") <= sample * step))
        return Envelope("sampleEvidenceAgreement", {"sampleSize": sample}, {"rate": picked.agg(F.count("*").alias("sampled"), F.avg(F.when(F.col("n") == 0, 1.0).otherwise(0.0)).alias("rate"))})

    def verify_claim(self, claim_ids: list[str], revision: str, strategy: str = "all") -> Envelope:
        """Runs the recipes of the claims; the store then has their evidence, history and successors."""
        guard({"claimIds": claim_ids, "strategy": strategy})
        c = self.store.at("claims").filter(F.col("id").isin(*claim_ids))
        recipes = c.select(F.col("id").alias("claim_id"), F.posexplode("recipes").alias("place", "r")).select("claim_id", "place", "r.*")
        outcomes = cl.run_recipes(recipes, self.store.at("nodes"), self.store.imports(), self.store["contents"])
        scored = c.select("id", "status", "confidence_band", "freshness_band", F.coalesce(F.size("supporting"), F.lit(0)).alias("n_supporting"))
        result = cl.verify(scored, outcomes, revision, strategy == "cheapest")
        new = outcomes.filter("evidence_kind is not null").withColumn("eid", cl.evidence_id(F.lit("verify"), F.lit(revision), "claim_id", "place"))
        self._append("evidence", new.select(F.col("eid").alias("id"), F.col("evidence_kind").alias("kind"), F.lit("static").alias("epistemic"), F.lit(revision).alias("revision"), "path", F.lit(None).cast("string").alias("actor"), F.to_json(F.struct("claim_id")).alias("metadata")))
        self._append("history", result.select(F.concat(F.lit("vh-"), "successor_id").alias("id"), "claim_id", "prior_status", "new_status", "prior_confidence", "new_confidence", F.lit(revision).alias("ran_at")))
        ids = new.groupBy(F.col("claim_id").alias("id")).agg(F.collect_list("eid").alias("more"), F.array_compact(F.collect_list(F.when(~F.col("passed"), F.col("eid")))).alias("against"))
        next_ = c.join(result.withColumnRenamed("claim_id", "id").select("id", "new_status", "new_confidence", "successor_id"), "id").join(ids, "id", "left")
        empty = F.array().cast("array<string>")
        next_ = next_.withColumns({
            "supporting": F.concat(F.coalesce("supporting", empty), F.coalesce("more", empty)), "contradicting": F.coalesce("against", empty), "id": F.col("successor_id"), "status": F.col("new_status"),
            "confidence_band": F.col("new_confidence"), "generation_id": F.concat(F.lit("gen-verify-"), "successor_id"), "valid_from": F.lit(revision),
        })
        self._succeed(c.select("id"), next_, revision)
        return Envelope("verifyClaim", {"claimIds": claim_ids, "strategy": strategy}, {"results": result, "outcomes": outcomes}, revision)

    def feedback(self, claim_ids: list[str], mode: str, actor: str, revision: str, note: str | None = None) -> Envelope:
        """Confirms, rejects or annotates claims by a person's evidence."""
        guard({"claimIds": claim_ids, "actor": actor, "note": note})
        if mode not in ("confirm", "reject", "annotate"):
            raise ValueError(f"no such feedback: {mode}")
        c = self.store.at("claims").filter(F.col("id").isin(*claim_ids))
        asked = self.spark.createDataFrame([(i, mode, revision) for i in dict.fromkeys(claim_ids)], "claim_id string, mode string, revision string")
        scored = c.select("id", "status", "freshness_band", F.coalesce(F.size("supporting"), F.lit(0)).alias("n_supporting"), F.coalesce(F.size("contradicting"), F.lit(0)).alias("n_contradicting"))
        result = cl.apply_feedback(scored, asked)
        eid = F.concat(F.lit("ev::human::"), "claim_id", F.lit("::"), F.lit(revision))
        known = result.filter("evidence_appended")
        self._append("evidence", known.select(eid.alias("id"), F.lit("human_annotation").alias("kind"), F.lit("inferred").alias("epistemic"), F.lit(revision).alias("revision"), F.lit(None).cast("string").alias("path"), F.lit(actor).alias("actor"), F.to_json(F.struct(F.lit(mode).alias("mode"), F.lit(note).alias("note"), F.col("claim_id").alias("claimId"))).alias("metadata")))
        seq = self.store["revisions"].agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        self._append("revisions", self.spark.createDataFrame([(revision, None, "working_tree", self.store.latest() or None, seq)], SCHEMAS["revisions"]))
        next_ = c.join(known.select(F.col("claim_id").alias("id"), "new_status", "new_confidence", "successor_id", eid.alias("eid")), "id")
        empty = F.array().cast("array<string>")
        side = lambda name, mine: F.when(F.lit(mine), F.concat(F.coalesce(name, empty), F.array("eid"))).otherwise(F.coalesce(name, empty))
        next_ = next_.withColumns({"supporting": side("supporting", mode != "reject"), "contradicting": side("contradicting", mode == "reject"), "id": F.col("successor_id"), "status": F.col("new_status"), "confidence_band": F.col("new_confidence"), "valid_from": F.lit(revision)})
        self._succeed(c.select("id"), next_, revision)
        return Envelope(f"{mode}Claim", {"claimIds": claim_ids, "actor": actor}, {"results": result}, revision)

    def subsystem_feedback(self, subsystem: str, mode: str, actor: str, revision: str, note: str | None = None) -> Envelope:
        """The same on the claims whose scope names the subsystem."""
        about = self.store.at("claims").filter(F.get_json_object("scope", "$.subsystemId") == subsystem).select("id").orderBy("id").first()
        return self.feedback([about[0] if about else subsystem], mode, actor, revision, note)

    def create_claim(self, claim_type: str, statement: str, scope: str, actor: str, revision: str) -> Envelope:
        guard({"type": claim_type, "statement": statement, "actor": actor})
        made = self.spark.range(1).select(cl.custom_claim(F.lit(claim_type), F.lit(statement), F.lit(actor)).alias("c")).select("c.*")
        self._append("evidence", made.select(F.col("evidence_id").alias("id"), F.lit("human_annotation").alias("kind"), F.lit("declared").alias("epistemic"), F.lit(revision).alias("revision"), F.lit(None).cast("string").alias("path"), F.lit(actor).alias("actor"), F.lit(None).cast("string").alias("metadata")))
        row = made.select("id", "claim_type", "statement", "status", F.lit(scope).alias("scope"), "confidence_band", F.lit("fresh").alias("freshness_band"), F.array("evidence_id").alias("supporting"), F.lit(revision).alias("valid_from"), "surfaced")
        self._append("claims", row)
        return Envelope("createCustomClaim", {"type": claim_type, "actor": actor}, {"claim": made}, revision)

    def _append(self, name: str, rows: DataFrame) -> None:
        old = self.store[name]
        full = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(old.schema[c].dataType).alias(c) for c in old.columns])
        self.store.tables[name] = temporal.insert_or_ignore(old, full, "id")

    def _succeed(self, ids: DataFrame, successors: DataFrame, revision: str) -> None:
        closed = cl.close({"claims": self.store["claims"]}, ids, revision)["claims"]
        self.store.tables["claims"] = closed.unionByName(successors.select(closed.columns))

    # -- revisions and rules --

    def compare_revisions(self, a: str, b: str) -> Envelope:
        """What two revisions don't share: files and symbols by stable key, edges and claims by id; and what may have been renamed by the second."""
        guard({"revA": a, "revB": b})
        diff = lambda df, key: temporal.difference(df, key, F.lit(a), F.lit(b))
        nodes = self.store["nodes"]
        data = {k: diff(nodes.filter(F.col("kind") == k), "stable_key") for k in ("file", "symbol")} | {"edges": diff(self.store["edges"], "id"), "claims": diff(self.store["claims"], "id")}
        renames = self.store.at("edges", b).filter("kind = 'rename_candidate'")
        data["renames"] = renames.select("src", "dst", F.expr("try_cast(get_json_object(metadata, '$.confidence') as double)").alias("confidence"))
        return Envelope("compareRevisions", {"revA": a, "revB": b}, data, b)

    def check_invariants(self, scope: str | None = None) -> Envelope:
        guard({"scope": scope})
        members = rules.membership(self.store.at("nodes").filter("path is not null").select("path").distinct(), self.store.boundaries)
        ends = rules.joined(self.store.import_paths(), members)
        found = rules.forbidden(ends, self.store.rules, scope).unionByName(rules.between_boundaries(ends, self.store.boundaries, scope))
        checked = len(self.store.rules) + (rules.checks_between(ends, scope).first()[0] if self.store.boundaries else 0)
        return Envelope("checkInvariants", {"scope": scope}, {"violations": found, "rules_checked": checked, "passed": found.isEmpty()})


class RuleBook:
    """Rules as they are written: added, removed, switched, exported and imported by name, each change in an audit list."""

    def __init__(self, definitions: list[dict] | None = None):
        self.rules, self.audit = list(definitions or []), []

    def _log(self, action: str, name: str, actor: str) -> None:
        self.audit.append({"actor": actor, "action": action, "rule": name})

    def _find(self, name: str) -> dict | None:
        return next((r for r in self.rules if r["name"] == name), None)

    def add(self, name: str, source: str = "**", target: str = "**", kind: str = "dependency-constraint", severity: str = "warning", actor: str = "cli-user") -> tuple[bool, str]:
        if not name:
            return False, "Rule name is required"
        if self._find(name):
            return False, f'Rule "{name}" already exists'
        self.rules.append({"name": name, "type": kind, "from": source, "to": target, "severity": severity})
        self._log("add", name, actor)
        return True, f'Rule "{name}" added'

    def remove(self, name: str, actor: str = "cli-user") -> tuple[bool, str]:
        if not self._find(name):
            return False, f'Rule "{name}" not found'
        self.rules = [r for r in self.rules if r["name"] != name]
        self._log("remove", name, actor)
        return True, f'Rule "{name}" removed'

    def switch(self, name: str, on: bool, actor: str = "cli-user") -> tuple[bool, str]:
        rule = self._find(name)
        if rule is None:
            return False, f'Rule "{name}" not found'
        rule["enabled"] = on
        self._log("enable" if on else "disable", name, actor)
        return True, f'Rule "{name}" {"enabled" if on else "disabled"}'

    def listed(self) -> list[dict]:
        return [{**r, "status": "enabled" if r.get("enabled", True) else "disabled", "source": "explicit"} for r in self.rules]

    def explicit(self, repository: str) -> list[rules.Rule]:
        return rules.explicit(repository, [r for r in self.rules if r["type"] == "forbidden_import"])

    def test(self, name: str, ends: DataFrame, repository: str = "repo::unknown") -> DataFrame:
        """The violations of one rule; ends: as `rules.joined` gives them."""
        rule = self._find(name)
        return rules.forbidden(ends, rules.explicit(repository, [rule] if rule and rule["type"] == "forbidden_import" else []))

    def exported(self, now: str) -> dict:
        return {"version": 1, "rules": [{**{k: v for k, v in r.items() if k not in ("from", "to")}, "from": {"pathGlob": r["from"]}, "to": {"pathGlob": r["to"]}} for r in self.rules], "exportedAt": now}

    def imported(self, document: Any, actor: str = "cli-user") -> dict:
        """How many were taken and skipped (the name is known), and why others were rejected."""
        wrong = lambda reason: {"imported": 0, "skipped": 0, "rejected": [{"index": -1, "reason": reason}]}
        if not isinstance(document, dict) or "version" not in document or "rules" not in document:
            return wrong("Invalid import format: missing version or rules")
        if document["version"] != 1:
            return wrong(f"Unsupported version: {document['version']}")
        if not isinstance(document["rules"], list):
            return wrong("Invalid import format: rules must be an array")
        n = skipped = 0
        rejected = []
        for i, r in enumerate(document["rules"]):
            text = lambda x: isinstance(x, str) and bool(x)
            side = lambda s, r=r: isinstance(r.get(s), dict) and isinstance(r[s].get("pathGlob"), str)
            if not isinstance(r, dict):
                reason = "Not an object"
            else:
                checks = [("name", text(r.get("name"))), ("type", text(r.get("type"))), ("from.pathGlob", side("from")), ("to.pathGlob", side("to")), ("severity", text(r.get("severity")))]
                reason = next((f"Missing or invalid {k}" for k, ok in checks if not ok), None)
            if reason:
                rejected.append({"index": i, "reason": reason})
            elif self._find(r["name"]):
                skipped += 1
            else:
                self.rules.append({"name": r["name"], "type": r["type"], "from": r["from"]["pathGlob"], "to": r["to"]["pathGlob"], "severity": r["severity"]} | ({"enabled": r["enabled"]} if isinstance(r.get("enabled"), bool) else {}))
                self._log("import", r["name"], actor)
                n += 1
        return {"imported": n, "skipped": skipped, "rejected": rejected}
