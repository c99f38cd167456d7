"""All registered queries of the evidence-graph operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import excludes, paths, scoring, secrets
from ..operators import graph, imports, ranges, retrieval, temporal
from ..sources import tables as t
from ..streaming import revisions

_Q: dict = {}
_SQL: dict[str, str] = {}
_WHOLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def whole(name: str):
    """Registers a query over everything, whose twin in SQL covers a part only or recurses too long; fixtures in tests hold it."""

    def add(f):
        _WHOLE[name] = f
        return f

    return add


def queries() -> dict:
    return dict(_Q)


def whole_queries() -> dict:
    return dict(_WHOLE)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- graph -----------------------------------------------------------------------

CONTAINS = """
contains_edges AS (
  SELECT 'edge::contains::' || src || '::' || dst AS id, src, dst FROM (
    SELECT 'node::region::' || n_regionkey AS src, 'node::nation::' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'node::nation::' || c_nationkey, 'node::customer::' || c_custkey FROM customer
    UNION ALL SELECT 'node::nation::' || s_nationkey, 'node::supplier::' || s_suppkey FROM supplier))"""
IMPORTS = """
import_lines AS (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst,
         (l_discount < 0.02 OR l_linestatus = 'O') AS unc FROM lineitem),
imports AS (SELECT src, dst, bool_or(unc) AS uncertain FROM import_lines WHERE dst IS NOT NULL AND dst <> src GROUP BY 1, 2)"""
PREFIX = "imports_small AS (SELECT src, dst FROM imports WHERE src % 40 = 7 AND dst % 5 <> 0)"


@query("containment_closure", f"""WITH RECURSIVE {CONTAINS},
walk AS (SELECT 'node::region::0' AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN contains_edges e ON e.src = w.node)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node""")
def containment_closure(spark: SparkSession, d: str) -> DataFrame:
    """Everything below a root over contains edges."""
    return graph.reach(t.contains_edges(spark, d), spark.createDataFrame([("node::region::0",)], "node string"))


@query("repo_overview", f"""WITH RECURSIVE {CONTAINS},
walk AS (SELECT 'node::region::0' AS node UNION SELECT e.dst FROM walk w JOIN contains_edges e ON e.src = w.node)
SELECT split_part(node, '::', 2) AS kind, count(*) AS n FROM walk GROUP BY 1""")
def repo_overview(spark, d):
    """What a root contains, by kind."""
    return containment_closure(spark, d).groupBy(F.split_part("node", F.lit("::"), F.lit(2)).alias("kind")).agg(F.count("*").alias("n"))


@query("neighbors_bowtie_d2", f"""WITH RECURSIVE {CONTAINS},
walk AS (
  SELECT id, src, dst, 1 AS depth FROM contains_edges WHERE src = 'node::nation::3' OR dst = 'node::nation::3'
  UNION SELECT e.id, e.src, e.dst, w.depth + 1 FROM walk w JOIN contains_edges e ON (e.src = w.dst OR e.dst = w.src) AND e.id <> w.id WHERE w.depth < 3)
SELECT DISTINCT id, src, dst, CAST(depth AS INTEGER) AS depth FROM walk""")
def neighbors_bowtie(spark, d):
    """Edges at a node, then edges that leave a reached end or enter a reached start."""
    return graph.bow_tie(t.contains_edges(spark, d), "node::nation::3", 3)


@query("inbound_edges", f"WITH {CONTAINS} SELECT id, src, dst FROM contains_edges WHERE dst = 'node::nation::3'")
def inbound_edges(spark, d):
    """D3."""
    return t.contains_edges(spark, d).filter("dst = 'node::nation::3'").select("id", "src", "dst")


@query("all_edges", f"WITH {CONTAINS} SELECT src, dst FROM contains_edges WHERE dst LIKE 'node::supplier::%'")
def all_edges(spark, d):
    """D4, B3."""
    return t.contains_edges(spark, d).filter(F.col("dst").startswith("node::supplier::")).select("src", "dst")


BLAST = f"""WITH RECURSIVE {IMPORTS},
both_ways AS (SELECT src, dst FROM imports UNION SELECT dst, src FROM imports),
walk AS (SELECT CAST(7 AS BIGINT) AS node, 0 AS distance UNION SELECT b.dst, w.distance + 1 FROM walk w JOIN both_ways b ON b.src = w.node WHERE w.distance < 2),
hit AS (SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM walk GROUP BY node)"""


BLAST_DEPTH, TRACE_DEPTH = 5, 10  # the reference's defaults


def _blast(spark, d, depth=2) -> DataFrame:
    return graph.reach(graph.either_way(t.import_edges(spark, d)), spark.range(7, 8).withColumnRenamed("id", "node"), depth).select("node", F.col("depth").alias("distance"))


def _risky(spark, d, depth=2) -> DataFrame:
    near = _blast(spark, d, depth).filter(F.col("distance") < depth).select("node")
    e = t.import_edges(spark, d).filter("uncertain").select("src", "dst")
    return e.join(near, e["src"] == near["node"], "left_semi").union(e.join(near, e["dst"] == near["node"], "left_semi")).distinct()


def _trace(spark, d, depth=4) -> DataFrame:
    hit = graph.reach(graph.either_way(t.import_edges(spark, d)), spark.range(7, 8).withColumnRenamed("id", "node"), depth)
    return hit.agg(F.count("*").alias("reached"), F.max("depth").alias("farthest"), F.sum("depth").alias("total"))


@query("blast_radius", BLAST + " SELECT node, distance FROM hit")
def blast_radius(spark, d):
    """Distances in an undirected breadth-first search."""
    return _blast(spark, d)


@query("risky_edges", BLAST + " SELECT DISTINCT i.src, i.dst FROM imports i WHERE i.uncertain AND (i.src IN (SELECT node FROM hit WHERE distance < 2) OR i.dst IN (SELECT node FROM hit WHERE distance < 2))")
def risky_edges(spark, d):
    """Uncertain edges that the search scans."""
    return _risky(spark, d)


@query("trace_shortest_path_len", BLAST.replace("w.distance < 2", "w.distance < 4") + " SELECT count(*) AS reached, CAST(max(distance) AS INTEGER) AS farthest, CAST(sum(distance) AS BIGINT) AS total FROM hit")
def trace_len(spark, d):
    """Lengths of the shortest paths from one start."""
    return _trace(spark, d)


@whole("blast_radius_full")
def blast_radius_full(spark, d):
    """To the reference's depth."""
    return _blast(spark, d, BLAST_DEPTH)


@whole("risky_edges_full")
def risky_edges_full(spark, d):
    """To the reference's depth."""
    return _risky(spark, d, BLAST_DEPTH)


@whole("trace_shortest_path_len_full")
def trace_len_full(spark, d):
    """To the reference's depth."""
    return _trace(spark, d, TRACE_DEPTH)


@query("import_fan_metrics", f"""WITH {IMPORTS} SELECT coalesce(a.node, b.node) AS node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out
FROM (SELECT dst AS node, count(DISTINCT src) AS fan_in FROM imports GROUP BY 1) a FULL JOIN (SELECT src AS node, count(DISTINCT dst) AS fan_out FROM imports GROUP BY 1) b ON a.node = b.node""")
def import_fan(spark, d):
    """D7."""
    return graph.fan(t.import_edges(spark, d))


@query("import_graph_totals", f"""WITH {IMPORTS} SELECT count(*) AS edges, count(DISTINCT src) AS sources, round(count(*) * 1.0 / count(DISTINCT src), 2) AS avg_fan_out FROM imports""")
def import_totals(spark, d):
    """Totals."""
    return t.import_edges(spark, d).agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.round(F.count("*") / F.count_distinct("src"), 2).alias("avg_fan_out"))


@query("import_transitive_closure", f"""WITH RECURSIVE {IMPORTS}, {PREFIX},
walk AS (SELECT src AS node FROM imports_small WHERE src < 200 UNION SELECT i.dst FROM walk w JOIN imports_small i ON i.src = w.node) SELECT node FROM walk""")
def import_closure(spark, d):
    """Multi-seed forward reachability over a sub-graph."""
    e = t.import_edges(spark, d).filter("src % 40 = 7 and dst % 5 <> 0")
    return graph.reach(e, e.filter("src < 200").select(F.col("src").alias("node"))).select("node")


@whole("import_transitive_closure_all")
def import_closure_all(spark, d):
    """Forward reachability over all imports, from every part below 200 that imports."""
    e = t.import_edges(spark, d)
    return graph.reach(e, e.filter("src < 200").select(F.col("src").alias("node"))).select("node")


@query("import_cycles", f"""WITH RECURSIVE {IMPORTS}, sub AS (SELECT src, dst FROM imports WHERE src < 160 AND dst < 160),
walk AS (SELECT src AS a, dst AS b FROM sub UNION SELECT w.a, s.dst FROM walk w JOIN sub s ON s.src = w.b),
mutual AS (SELECT x.a, x.b FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a)
SELECT a AS node, min(b) AS component FROM mutual GROUP BY a""")
def import_cycles(spark, d):
    """Strongly connected components with a cycle, of a sub-graph."""
    return graph.strong_components(t.import_edges(spark, d).filter("src < 160 and dst < 160").select("src", "dst"))


@whole("import_cycles_all")
def import_cycles_all(spark, d):
    """Strongly connected components with a cycle, of all imports."""
    return graph.strong_components(t.import_edges(spark, d).select("src", "dst"))


COCHANGE = """pairs AS (SELECT a.l_partkey AS fa, b.l_partkey AS fb, count(DISTINCT a.l_orderkey) AS n
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2)"""


def _cochange(spark, d) -> DataFrame:
    li = t.load(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    small = li.groupBy("l_orderkey").agg(F.count("*").alias("c")).filter("c <= 50").select("l_orderkey")
    li = li.join(small, "l_orderkey", "left_semi")
    return li.alias("a").join(li.alias("b"), "l_orderkey").filter("a.l_partkey < b.l_partkey").groupBy(F.col("a.l_partkey").alias("fa"), F.col("b.l_partkey").alias("fb")).agg(F.count("*").alias("n"))


@query("cochange_pairs", f"WITH {COCHANGE} SELECT fa, fb, n, CASE WHEN n >= 5 THEN 'medium' ELSE 'low' END AS band FROM pairs WHERE n >= 2")
def cochange_pairs(spark, d):
    """Files changed together; commits of over 50 files are left out."""
    return _cochange(spark, d).filter("n >= 2").withColumn("band", F.when(F.col("n") >= 5, "medium").otherwise("low"))


@query("cochange_clusters", f"""WITH RECURSIVE {COCHANGE}, strong AS (SELECT fa, fb FROM pairs WHERE n >= 2), und AS (SELECT fa AS a, fb AS b FROM strong UNION SELECT fb, fa FROM strong),
walk AS (SELECT a AS node, a AS seen FROM und UNION SELECT w.node, u.b FROM walk w JOIN und u ON u.a = w.seen)
SELECT component, count(*) AS files FROM (SELECT node, min(seen) AS component FROM walk GROUP BY node) GROUP BY 1 HAVING count(*) >= 3""")
def cochange_clusters(spark, d):
    """Connected components of the pairs that recur."""
    e = _cochange(spark, d).filter("n >= 2").select(F.col("fa").alias("src"), F.col("fb").alias("dst"))
    return graph.components(e).groupBy("component").agg(F.count("*").alias("files")).filter("files >= 3")


# -- versions ----------------------------------------------------------------------

REVS = """revs AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate, lag(o_orderstatus) OVER w AS prev, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
starts AS (SELECT * FROM revs WHERE rn = 1 OR prev IS DISTINCT FROM o_orderstatus),
vers AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM starts)"""


def _versions(spark, d) -> DataFrame:
    log = t.load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return temporal.versions(log, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).select("o_custkey", "o_orderstatus", "o_orderkey", "valid_from", "valid_to")


@query("scd2_versions", f"WITH {REVS} SELECT o_custkey, o_orderkey, o_orderstatus, epoch(valid_from)::BIGINT AS valid_from, epoch(valid_to)::BIGINT AS valid_to FROM vers")
def scd2_versions(spark, d):
    """Interval versions of a log."""
    return _versions(spark, d).select("o_custkey", "o_orderkey", "o_orderstatus", F.unix_timestamp("valid_from").alias("valid_from"), F.unix_timestamp("valid_to").alias("valid_to"))


@query("asof_nodes", f"WITH {REVS} SELECT o_custkey, o_orderkey, o_orderstatus FROM vers WHERE valid_from <= TIMESTAMP '1996-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-01-01')")
def asof_nodes(spark, d):
    """Rows visible at a revision."""
    return _versions(spark, d).filter(temporal.visible(F.lit("1996-01-01").cast("timestamp"))).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("revision_diff", f"""WITH {REVS}, seen AS (SELECT o_custkey || '/' || o_orderstatus AS k,
  bool_or(valid_from <= TIMESTAMP '1995-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1995-01-01')) AS a, bool_or(valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')) AS b FROM vers GROUP BY 1)
SELECT k, CASE WHEN b THEN 'added' ELSE 'removed' END AS change FROM seen WHERE a <> b""")
def revision_diff(spark, d):
    """What two revisions don't share."""
    v = _versions(spark, d).withColumn("k", F.concat(F.col("o_custkey").cast("string"), F.lit("/"), "o_orderstatus"))
    return temporal.difference(v, "k", F.lit("1995-01-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp"))


@query("latest_version", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_version(spark, d):
    """F6."""
    return t.load(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("replace_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def replace_latest(spark, d):
    """The last row per key wins."""
    o = t.load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return temporal.replace_latest(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("insert_or_ignore", "SELECT c_custkey AS id, 'old' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def insert_or_ignore(spark, d):
    """The first write wins."""
    c = t.load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return temporal.insert_or_ignore(c.filter("id % 2 = 0").withColumn("origin", F.lit("old")), c.filter("id % 3 = 0").withColumn("origin", F.lit("new")), "id")


SNAP = """stored AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0),
current AS (SELECT 'doc/' || doc_id AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 5 <> 0)"""


def _snapshots(spark, d):
    docs = t.load(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))
    stored = docs.filter("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    current = docs.filter("doc_id % 5 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return stored, current


@query("hash_diff", f"""WITH {SNAP} SELECT coalesce(s.path, c.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN s.hash = c.hash THEN 'unchanged' ELSE 'changed' END AS change
FROM stored s FULL JOIN current c ON s.path = c.path""")
def hash_diff(spark, d):
    """Stored against current fingerprints."""
    return temporal.hash_diff(*_snapshots(spark, d))


@query("rename_candidates", f"""WITH {SNAP}, gone AS (SELECT * FROM stored WHERE path NOT IN (SELECT path FROM current)), fresh AS (SELECT * FROM current WHERE path NOT IN (SELECT path FROM stored))
SELECT g.path AS old_path, f.path AS new_path FROM gone g JOIN fresh f ON g.hash = f.hash QUALIFY row_number() OVER (PARTITION BY g.path ORDER BY levenshtein(g.path, f.path) * 1.0 / greatest(length(g.path), length(f.path)), f.path) = 1""")
def rename_candidates(spark, d):
    """Equal content under another path; the most similar name first."""
    stored, current = _snapshots(spark, d)
    gone, fresh = stored.join(current, "path", "left_anti"), current.join(stored, "path", "left_anti")
    j = gone.select(F.col("path").alias("old_path"), "hash").join(fresh.select(F.col("path").alias("new_path"), "hash"), "hash")
    return temporal.replace_latest(j, ["old_path"], [paths.similarity_distance(F.col("old_path"), F.col("new_path")), F.col("new_path")]).select("old_path", "new_path")


# -- scoring -----------------------------------------------------------------------

_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.RANKS.items()) + " ELSE 0 END"
_KINDS = "[" + ", ".join(f"'{k}'" for k in t.EVIDENCE_KINDS) + "]"
FOLD = f"""ev AS (SELECT event_id, user_id AS claim_id, {_KINDS}[event_id % {len(t.EVIDENCE_KINDS)} + 1] AS kind, event_id % 97 = 0 AS contra, ts FROM events),
fold AS (SELECT claim_id, count(*) FILTER (NOT contra) AS n_evidence, max({_RANK}) FILTER (NOT contra) AS top_rank, count(*) FILTER (NOT contra AND kind <> 'llm_derivation') AS n_solid, count(DISTINCT kind) FILTER (NOT contra AND kind <> 'llm_derivation') AS n_solid_kinds,
  count(*) FILTER (NOT contra AND kind = 'human_annotation') AS n_human, count(*) FILTER (contra) AS n_contra, CASE claim_id % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'aging' ELSE 'stale' END AS freshness, CASE claim_id % 5 WHEN 0 THEN 'rejected' ELSE 'hypothesis' END AS prior FROM ev GROUP BY claim_id),
raw AS (SELECT *, CASE WHEN top_rank >= 6 THEN 3 WHEN top_rank >= 4 THEN 2 ELSE 1 END + (n_solid >= 2)::INT + (n_solid_kinds >= 2)::INT + (n_human > 0)::INT AS up,
  CASE WHEN n_contra > 0 THEN 2 ELSE 0 END + CASE freshness WHEN 'stale' THEN 2 WHEN 'aging' THEN 1 ELSE 0 END AS down FROM fold),
scored AS (SELECT *, CASE WHEN n_evidence = 0 THEN 0 WHEN n_solid = 0 THEN least(2, greatest(0, least(3, up) - down)) ELSE greatest(0, least(3, up) - down) END AS band_no,
  CASE WHEN n_contra > 0 THEN 'contradicted' WHEN prior = 'rejected' THEN 'rejected' WHEN n_human > 0 OR n_solid > 0 THEN 'confirmed' ELSE 'hypothesis' END AS status FROM raw),
claims AS (SELECT *, ['none', 'low', 'medium', 'high'][band_no + 1] AS band FROM scored)"""


def _claims(spark, d) -> DataFrame:
    c = scoring.fold_evidence(t.evidence(spark, d))
    r3, r5 = F.col("claim_id") % 3, F.col("claim_id") % 5
    c = c.withColumn("freshness", F.when(r3 == 0, "fresh").when(r3 == 1, "aging").otherwise("stale")).withColumn("prior", F.when(r5 == 0, "rejected").otherwise("hypothesis"))
    return c.withColumn("band_no", scoring.confidence(F.col("freshness"))).withColumn("band", scoring.named(F.col("band_no"), scoring.BANDS)).withColumn("status", scoring.next_status(F.col("prior")))


@query("confidence_bands", f"WITH {FOLD} SELECT claim_id, band, n_evidence FROM claims")
def confidence_bands(spark, d):
    """I1, E8."""
    return _claims(spark, d).select("claim_id", "band", "n_evidence")


@query("freshness_bands", f"WITH {FOLD} SELECT claim_id, CASE WHEN n_evidence % 2 = 0 AND claim_id % 4 <> 1 THEN CASE freshness WHEN 'fresh' THEN 'aging' ELSE 'stale' END ELSE freshness END AS freshness FROM claims")
def freshness_bands(spark, d):
    """Touched claims step down, but those whose evidence is of the change's revision."""
    return _claims(spark, d).select("claim_id", scoring.step_down(F.col("freshness"), F.col("n_evidence") % 2 == 0, F.col("claim_id") % 4 == 1).alias("freshness"))


@query("claim_status", f"WITH {FOLD} SELECT claim_id, prior, status FROM claims")
def claim_status(spark, d):
    """I3."""
    return _claims(spark, d).select("claim_id", "prior", "status")


@query("surfaced_claims", f"WITH {FOLD} SELECT claim_id FROM claims WHERE n_evidence >= 1 AND claim_id % 7 >= 1 AND n_solid >= 1 AND band_no >= 2")
def surfaced_claims(spark, d):
    """B10; a claim has claim_id % 7 recipes."""
    return _claims(spark, d).filter(scoring.surfaceable(F.col("claim_id") % 7)).select("claim_id")


@query("list_claims_ranked", f"WITH {FOLD} SELECT claim_id, band, row_number() OVER (ORDER BY band_no DESC, claim_id) AS pos FROM claims WHERE band_no >= 2 AND status <> 'rejected'")
def list_claims(spark, d):
    """All by band, then id."""
    kept = _claims(spark, d).filter("band_no >= 2 and status <> 'rejected'").select("claim_id", "band", (3 - F.col("band_no")).alias("order"))
    return ranges.numbered(kept, ["order", "claim_id"], "pos").select("claim_id", "band", "pos")


@query("uncertainties", f"""WITH {FOLD} SELECT claim_id, 'missing_evidence' AS kind, 'high' AS severity FROM claims WHERE band = 'none' UNION ALL SELECT claim_id, 'low_confidence', 'medium' FROM claims WHERE band = 'low'
UNION ALL SELECT claim_id, 'stale', 'medium' FROM claims WHERE freshness = 'stale' UNION ALL SELECT claim_id, 'contradicted', 'high' FROM claims WHERE status = 'contradicted'""")
def uncertainties(spark, d):
    """H8: a claim can have several."""
    u = lambda cond, kind, sev: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(sev).alias("severity")))
    all_ = F.array(u(F.col("band") == "none", "missing_evidence", "high"), u(F.col("band") == "low", "low_confidence", "medium"), u(F.col("freshness") == "stale", "stale", "medium"), u(F.col("status") == "contradicted", "contradicted", "high"))
    return _claims(spark, d).select("claim_id", F.explode(F.array_compact(all_)).alias("u")).select("claim_id", "u.kind", "u.severity")


@query("evidence_agreement", f"WITH {FOLD}, n AS (SELECT *, row_number() OVER (ORDER BY claim_id) - 1 AS i, count(*) OVER () AS c FROM claims) SELECT count(*) AS sampled, round(avg(CASE WHEN n_contra = 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM n WHERE i % greatest(1, c // 10) = 0 AND i < 10 * greatest(1, c // 10)")
def evidence_agreement(spark, d):
    """A systematic sample of ten claims."""
    c = _claims(spark, d).select("claim_id", "n_contra")
    n = c.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10)).alias("step"))
    i = ranges.numbered(c, ["claim_id"], "i").withColumn("i", F.col("i") - 1).crossJoin(F.broadcast(n))  # one row
    s = i.filter("i % step = 0 and i < 10 * step")
    return s.agg(F.count("*").alias("sampled"), F.round(F.avg(F.when(F.col("n_contra") == 0, 1.0).otherwise(0.0)), 6).alias("rate"))


@query("verify_batch", f"WITH {FOLD} SELECT claim_id, band AS prior_band, CASE WHEN n_solid > 0 AND n_contra = 0 THEN 'passed' WHEN n_contra > 0 THEN 'contradicted' ELSE 'unresolved' END AS outcome FROM claims WHERE status <> 'rejected'")
def verify_batch(spark, d):
    """K3, K4: recipes of all open claims at once."""
    out = F.when((F.col("n_solid") > 0) & (F.col("n_contra") == 0), "passed").when(F.col("n_contra") > 0, "contradicted").otherwise("unresolved")
    return _claims(spark, d).filter("status <> 'rejected'").select("claim_id", F.col("band").alias("prior_band"), out.alias("outcome"))


@query("feedback_apply", f"""WITH {FOLD}, fb AS (SELECT user_id AS claim_id, max_by(CASE event_id % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' ELSE 'annotate' END, event_id) AS mode FROM events WHERE event_id % 10 = 0 GROUP BY 1)
SELECT c.claim_id, CASE WHEN mode = 'reject' THEN 'rejected' WHEN mode IS NULL THEN status WHEN n_contra > 0 THEN 'contradicted' WHEN status = 'rejected' THEN 'rejected' ELSE 'confirmed' END AS status, mode FROM claims c LEFT JOIN fb USING (claim_id)""")
def feedback_apply(spark, d):
    """K5: the last feedback per claim decides."""
    e = t.load(spark, d, "events").filter("event_id % 10 = 0")
    r = F.col("event_id") % 3
    fb = e.groupBy(F.col("user_id").alias("claim_id")).agg(F.max_by(F.when(r == 0, "confirm").when(r == 1, "reject").otherwise("annotate"), "event_id").alias("mode"))
    new = F.when(F.col("mode") == "reject", "rejected").when(F.col("mode").isNull(), F.col("status")).when(F.col("n_contra") > 0, "contradicted").when(F.col("status") == "rejected", "rejected").otherwise("confirmed")
    return _claims(spark, d).join(fb, "claim_id", "left").select("claim_id", new.alias("status"), "mode")


@query("partiality_rollup", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'none' WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'degraded' ELSE 'partial' END AS partiality FROM orders GROUP BY 1")
def partiality_rollup(spark, d):
    """E14."""
    failed = F.count_if(F.col("o_orderstatus") == "F")
    return t.load(spark, d, "orders").groupBy("o_custkey").agg(F.when(failed == 0, "none").when(failed == F.count("*"), "degraded").otherwise("partial").alias("partiality"))


@query("status_counts", "SELECT count(*) AS edges, count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_partkey) AS parts FROM lineitem")
def status_counts(spark, d):
    """Counters in one pass."""
    return t.load(spark, d, "lineitem").agg(F.count("*").alias("edges"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_partkey").alias("parts"))


@query("percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentiles(spark, d):
    """Nearest rank."""
    return t.load(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


# -- retrieval -----------------------------------------------------------------------

TOK = r"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("fts_phrase", f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({TOK}, ' ') || ' ' AS p FROM documents) WHERE contains(p, ' of the ')")
def fts_phrase(spark, d):
    """H1: the query is one phrase."""
    return retrieval.phrase(t.load(spark, d, "documents"), "of the").select("doc_id")


@query("fts_bm25", f"""WITH c AS (SELECT doc_id, len(t) AS len, len(list_filter(t, lambda x: x = 'the')) AS tf0, len(list_filter(t, lambda x: x = 'trash')) AS tf1 FROM (SELECT doc_id, {TOK} AS t FROM documents)),
s AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM c)
SELECT doc_id, round(ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * len / a)) + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * len / a)), 6) AS score FROM c, s WHERE tf0 > 0 OR tf1 > 0""")
def fts_bm25(spark, d):
    """H1: BM25 of two terms."""
    return retrieval.bm25(t.load(spark, d, "documents"), ["the", "trash"]).select("doc_id", F.round("score", 6).alias("score"))


@query("cosine_topk", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS c FROM embeddings, q)
SELECT vec_id, round(c, 6) AS score FROM s ORDER BY c DESC, vec_id LIMIT 10""")
def cosine_topk(spark, d):
    """The ten nearest to one vector."""
    e = t.load(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()
    return retrieval.top_k(e, q[0] if q else [], 10).select("vec_id", F.round("score", 6).alias("score"))


@query("embedding_coverage", "SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) AS embedded")
def embedding_coverage(spark, d):
    """H3."""
    docs = t.load(spark, d, "documents").select("doc_id")
    e = t.load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")).distinct().withColumn("hit", F.lit(1))
    return docs.join(e, "doc_id", "left").agg(F.count("*").alias("total"), F.count("hit").alias("embedded"))


@query("hybrid_retrieval", f"""WITH a AS (SELECT doc_id AS id, 'symbolic' AS source, 100 AS rank, 0 AS stage FROM documents WHERE doc_id % 97 = 0
UNION ALL SELECT doc_id, 'lexical', 80, 1 FROM (SELECT doc_id, {TOK} AS t FROM documents) WHERE list_contains(t, 'trash') UNION ALL SELECT vec_id, 'semantic', 60 + vec_id % 20, 2 FROM embeddings WHERE label = 1)
SELECT id, source, CAST(rank AS BIGINT) AS rank FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank DESC, stage) = 1""")
def hybrid_retrieval(spark, d):
    """Anchors of several stages, the best rank per id."""
    docs = t.load(spark, d, "documents")
    stage = lambda df, id_, name, rank, k: df.select(F.col(id_).alias("id"), F.lit(name).alias("source"), rank.cast("long").alias("rank"), F.lit(k).alias("stage"))
    a = stage(docs.filter("doc_id % 97 = 0"), "doc_id", "symbolic", F.lit(100), 0)
    b = stage(docs.filter(F.array_contains(retrieval.tokens(F.col("text")), "trash")), "doc_id", "lexical", F.lit(80), 1)
    c = stage(t.load(spark, d, "embeddings").filter("label = 1"), "vec_id", "semantic", 60 + F.col("vec_id") % 20, 2)
    return retrieval.merge_ranks(a.unionByName(b).unionByName(c)).drop("stage")


@query("resolve_reference", "SELECT id, strategy FROM (SELECT 'node::part::' || p_partkey AS id, 'path' AS strategy, 1 AS o FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 5) UNION ALL SELECT 'node::part::' || p_partkey, 'intent', 2 FROM part WHERE p_brand = 'Brand#11') QUALIFY o = min(o) OVER ()")
def resolve_reference(spark, d):
    """H9: the first strategy with any candidate."""
    p = t.load(spark, d, "part")
    name = p.filter("p_partkey = 5").select("p_name").distinct()
    first = p.join(name, "p_name", "left_semi").select(t.node_id("part", F.col("p_partkey")).alias("id"), F.lit("path").alias("strategy"), F.lit(1).alias("o"))
    second = p.filter("p_brand = 'Brand#11'").select(t.node_id("part", F.col("p_partkey")).alias("id"), F.lit("intent").alias("strategy"), F.lit(2).alias("o"))
    all_ = first.unionByName(second)
    return all_.join(F.broadcast(all_.agg(F.min("o").alias("m"))), F.col("o") == F.col("m")).select("id", "strategy")  # one row


# -- rules, paths, groups ------------------------------------------------------------

SHIPS = """ships AS (SELECT DISTINCT c.c_nationkey AS a, s.s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey WHERE l_quantity >= 50)"""


def _ships(spark, d) -> DataFrame:
    c = t.load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    s = t.load(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    o = t.load(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "a")
    li = t.load(spark, d, "lineitem").filter("l_quantity >= 50").select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "b")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("a", "b").distinct()


@query("forbidden_import_violations", f"WITH {SHIPS} SELECT a, b FROM ships WHERE a < 5 AND b >= 20")
def forbidden_imports(spark, d):
    """Edges that a rule forbids."""
    return _ships(spark, d).filter("a < 5 and b >= 20")


@query("boundary_violations", f"WITH {SHIPS} SELECT s.a, s.b, x.n_regionkey AS ra, y.n_regionkey AS rb FROM ships s JOIN nation x ON s.a = x.n_nationkey JOIN nation y ON s.b = y.n_nationkey WHERE x.n_regionkey <> y.n_regionkey AND NOT (x.n_regionkey = 0 AND y.n_regionkey = 1)")
def boundary_violations(spark, d):
    """Edges across boundaries that aren't allowed."""
    n = t.load(spark, d, "nation").select("n_nationkey", "n_regionkey")
    s = _ships(spark, d).join(n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ra")), "a").join(n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("rb")), "b")
    return s.filter("ra <> rb and not (ra = 0 and rb = 1)").select("a", "b", "ra", "rb")


@query("boundary_coverage", "SELECT CAST(round(100.0 * count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) / count(*)) AS BIGINT) AS percent FROM customer")
def boundary_coverage(spark, d):
    """E7."""
    return t.load(spark, d, "customer").agg(F.round(100.0 * F.count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")) / F.count("*")).cast("long").alias("percent"))


URLPATH = r"regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1)"


@query("classify_paths", f"SELECT page_id, CASE WHEN regexp_matches(p, '\\.html?$') THEN 'doc' WHEN regexp_matches(p, '^/[a-z]+/[0-9]+/?$') THEN 'source' ELSE 'other' END AS file_class, regexp_matches(p, '^/en/[^/]*$') AS in_scope FROM (SELECT page_id, {URLPATH} AS p FROM pages)")
def classify_paths(spark, d):
    """Ordered path classes and a glob."""
    p = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1)
    kind = F.when(p.rlike(r"\.html?$"), "doc").when(p.rlike("^/[a-z]+/[0-9]+/?$"), "source").otherwise("other")
    return t.load(spark, d, "pages").select("page_id", kind.alias("file_class"), paths.glob(p, "/en/*").alias("in_scope"))


@query("page_links", """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""")
def page_links(spark, d):
    """Links by a pattern."""
    return t.load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("directory_groups", "SELECT split_part(p_type, ' ', 1) AS dir, count(*) AS files FROM part GROUP BY 1 HAVING count(*) >= 2")
def directory_groups(spark, d):
    """E4."""
    return t.load(spark, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("dir")).agg(F.count("*").alias("files")).filter("files >= 2")


@query("directory_expansion", "SELECT DISTINCT array_to_string(s[1:i], ' ') AS dir FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT string_split(p_type, ' ') AS s FROM part))")
def directory_expansion(spark, d):
    """All ancestors of every path."""
    s = F.split("p_type", " ")
    return t.load(spark, d, "part").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, F.lit(1), i), " "))).alias("dir")).distinct()


@query("subsystem_merge", "SELECT p_brand AS id, count(DISTINCT p_type) AS kinds, max_by(p_name, (length(p_name), p_name)) AS name, max(p_size) AS top FROM part GROUP BY 1")
def subsystem_merge(spark, d):
    """E5: rows of one id merge: union of paths, longest name, best band."""
    return t.load(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.count_distinct("p_type").alias("kinds"), F.max_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("name"), F.max("p_size").alias("top"))


@query("undeclared_dependency", f"WITH {SHIPS} SELECT a, b FROM ships WHERE NOT EXISTS (SELECT 1 FROM ships t WHERE t.a = ships.b AND t.b = ships.a)")
def undeclared(spark, d):
    """Pairs without their reverse."""
    s = _ships(spark, d)
    r = s.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return s.join(r, ["a", "b"], "left_anti")


@query("layer_rule_candidates", f"WITH {SHIPS}, r AS (SELECT a, count(*) AS n, string_agg(b::VARCHAR, ',' ORDER BY b) AS targets FROM ships GROUP BY 1) SELECT a, n, targets FROM r WHERE n < 25")
def layer_candidates(spark, d):
    """What each layer reaches, in order."""
    return _ships(spark, d).groupBy("a").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("b")), ",").alias("targets")).filter("n < 25")


@query("claim_history", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def claim_history(spark, d):
    """History in order."""
    return t.load(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"))


@query("json_metadata", "SELECT event_type, count(*) AS n, sum(TRY_CAST(props ->> '$.k' AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_metadata(spark, d):
    """Tolerant reads of JSON text."""
    return t.load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.expr("try_cast(get_json_object(props, '$.k') as bigint)")).alias("k"))


# -- sources, parsing, streams ---------------------------------------------------------

IGNORE, LEFT_OUT = ["*.html", "!en/*.html", "de/"], ["es/**"]
_REL = f"ltrim({URLPATH}, '/')"


@query("excluded_paths", f"""SELECT page_id, CASE WHEN regexp_matches(p, '^(.*/)?(\\.env|secret[^/]*|credentials\\.[^/]*)$') THEN 'secret' WHEN regexp_matches(p, '^es/.*$') THEN 'config'
WHEN p = 'de' OR regexp_matches(p, '^(.*/)?de$') THEN 'ignore' WHEN regexp_matches(p, '^en/[^/]*\\.html$') THEN NULL WHEN regexp_matches(p, '\\.html$') THEN 'ignore' END AS reason FROM (SELECT page_id, {_REL} AS p FROM pages)""")
def excluded_paths(spark, d):
    """A2: secrets, configured globs, then ignore lines of which the last match decides."""
    p = F.ltrim(F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    return t.load(spark, d, "pages").select("page_id", excludes.excluded(p, LEFT_OUT, IGNORE).alias("reason"))


def _scrub_sql() -> str:
    text, counts = "text", []
    for name, pattern in secrets.PATTERNS.items():
        lit = pattern.replace("'", "''")
        counts.append(f"len(regexp_extract_all({text}, '{lit}'))")
        text = f"regexp_replace({text}, '{lit}', '[REDACTED {name}]', 'g')"
    return f"SELECT doc_id, coalesce({' + '.join(counts)}, 0)::BIGINT AS secrets_found, sha256({text}) AS scrubbed_sha256 FROM documents"


@query("secret_scrub", _scrub_sql())
def secret_scrub(spark, d):
    """Texts without secrets, and how many there were."""
    text = F.col("text")
    return t.load(spark, d, "documents").select("doc_id", secrets.found(text).cast("long").alias("secrets_found"), F.sha2(secrets.scrub(text), 256).alias("scrubbed_sha256"))


@query("activity_stream", "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def activity_stream(spark, d):
    """Beyond the reference: counts per day and kind, from a stream of the events."""
    events = spark.readStream.schema(t.load(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # as a pattern the table may be one file or a folder
    return revisions.drain(revisions.activity(events), ["start", "event_type"]).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("symbol_fallback", """WITH i AS (SELECT DISTINCT o_custkey AS path, o_orderdate AS name FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT DISTINCT o_custkey AS target, o_orderdate AS name FROM orders WHERE o_orderstatus = 'P'),
h AS (SELECT path, name, target, count(*) OVER (PARTITION BY path, name) AS n FROM i JOIN s USING (name) WHERE path <> target) SELECT path, epoch(name)::BIGINT AS name, target, CASE n WHEN 1 THEN 'medium' ELSE 'low' END AS band FROM h""")
def symbol_fallback(spark, d):
    """Who defines what is imported by name; a single target is surer."""
    o = t.load(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderdate").alias("name"), "o_orderstatus")
    out = imports.by_symbol(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"))
    return out.select("path", F.unix_timestamp("name").alias("name"), "target", "band")
