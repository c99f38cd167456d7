"""Claims: generation, verification, feedback and the tables that keep them.

Everything works on tables of claims at once. Ids follow from content, so a task that
runs again writes the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

CLAIM = "id string, claim_type string, statement string, status string, confidence_band string, freshness_band string, scope string, recipes array<struct<type:string,target:string>>, surfaced boolean"


def package_of(id_or_path: Column) -> Column:
    """The directory below `packages/`; null outside."""
    name = F.regexp_extract(id_or_path, r"packages/([^/]+)/", 1)
    return F.when(name != "", name)


def evidence_id(*parts) -> Column:
    return F.concat(F.lit("ev::"), F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 32))


def _claim(df: DataFrame, claim_id: Column, kind: str, statement: Column, scope: Column, evidence_kind: str, n: Column, recipe: str, target: Column, key: Column) -> DataFrame:
    """Claims over n pieces of evidence of one kind, scored as fresh ones."""
    made = df.select(
        claim_id.alias("id"), F.lit(kind).alias("claim_type"), statement.alias("statement"), F.lit("hypothesis").alias("status"), F.to_json(scope).alias("scope"),
        F.lit("fresh").alias("freshness_band"), F.array(F.struct(F.lit(recipe).alias("type"), target.alias("target"))).alias("recipes"), n.cast("long").alias("n_evidence"), key.alias("evidence_key"),
    )
    scored = made.withColumns({
        "top_rank": F.lit(scoring.RANKS[evidence_kind]), "n_solid": F.col("n_evidence"), "n_solid_kinds": F.least(F.col("n_evidence"), F.lit(1)),
        "n_human": F.lit(0), "n_contra": F.lit(0), "evidence_kind": F.lit(evidence_kind),
    })
    scored = scored.withColumn("band_no", scoring.confidence(F.lit("fresh")))
    return scored.withColumns({"confidence_band": scoring.named(F.col("band_no"), scoring.BANDS), "surfaced": scoring.surfaceable(F.size("recipes"))}).select(
        "id", "claim_type", "statement", "status", "confidence_band", "freshness_band", "scope", "recipes", "surfaced", "n_evidence", "evidence_kind", "evidence_key"
    )


def file_symbols(symbols: DataFrame, repo: str) -> DataFrame:
    """One claim a file of (path, name, exported, place): its symbols in order, one piece of evidence each."""
    of = symbols.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]), ", ").alias("names"), F.max("exported").alias("exported"), F.count("*").alias("n"))
    stem = F.concat(F.lit(f"claim::file::{repo}::"), "path", F.lit("::defines"))
    return _claim(of, stem, "file-defines-symbols", F.concat(F.lit("File "), "path", F.lit(" defines symbols: "), "names"), F.struct("exported", "path"), "tree_sitter_query", F.col("n"), "symbol_exists_check", F.lit(None).cast("string"), F.col("path"))


def package_imports(imports: DataFrame, repo: str) -> DataFrame:
    """One claim for each two packages of which one imports the other; imports: (from_path, to_path)."""
    a, b = package_of(F.col("from_path")), package_of(F.col("to_path"))
    pairs = imports.select(a.alias("a"), b.alias("b")).filter("a <> b").distinct()
    return _claim(
        pairs, F.concat(F.lit(f"claim::package::{repo}::"), "a", F.lit("::imports::"), "b"), "package-imports-package", F.concat(F.lit("Package "), "a", F.lit(" imports package "), "b"),
        F.struct(F.col("a").alias("fromPackage"), F.col("b").alias("toPackage")), "static_analysis_result", F.lit(1), "import_edge_check", F.lit(None).cast("string"), F.concat("a", F.lit("::"), "b"),
    )


def subsystem_hypotheses(subsystems: DataFrame) -> DataFrame:
    """One claim for each of (id, name, source, paths)."""
    return _claim(
        subsystems, F.concat(F.lit("claim::"), "id", F.lit("::hypothesis")), "directory-derived-subsystem-hypothesis", F.concat(F.lit('Subsystem "'), "name", F.lit('" inferred from '), "source", F.lit(" grouping")),
        F.struct(F.col("id").alias("subsystemId"), "paths"), "static_analysis_result", F.lit(1), "grep_check", F.lit(None).cast("string"), F.col("id"),
    )


def entrypoints(files: DataFrame, repo: str) -> DataFrame:
    """One claim for each path."""
    return _claim(
        files, F.concat(F.lit(f"claim::file::{repo}::"), "path", F.lit("::entrypoint")), "likely-entrypoint", F.concat(F.lit("File "), "path", F.lit(" is a likely entry point")),
        F.struct("path"), "static_analysis_result", F.lit(1), "source_span_check", F.lit(None).cast("string"), F.col("path"),
    )


def generate(symbols: DataFrame, imports: DataFrame, subsystems: DataFrame, entry_files: DataFrame, repo: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [file_symbols(symbols, repo), package_imports(imports, repo), subsystem_hypotheses(subsystems), entrypoints(entry_files, repo)])


# -- subsystems ---------------------------------------------------------------------


def directory_subsystems(files: DataFrame) -> DataFrame:
    """(id, name, source, paths, confidence) of top directories with two files or more."""
    top = F.get(F.split("path", "/"), F.lit(0))
    many = files.filter(F.col("path").contains("/")).select(top.alias("dir")).filter(~F.col("dir").startswith(".") & ~F.col("dir").isin("node_modules", "dist")).groupBy("dir").agg(F.count("*").alias("n")).filter("n >= 2")
    return many.select(F.concat(F.lit("subsystem::dir::"), "dir").alias("id"), F.col("dir").alias("name"), F.lit("directory").alias("source"), F.array(F.concat("dir", F.lit("/**"))).alias("paths"), F.lit("low").alias("confidence"))


def package_subsystems(packages: DataFrame) -> DataFrame:
    """The same columns of (name, path) packages."""
    return packages.select(F.concat(F.lit("subsystem::package::"), "name").alias("id"), "name", F.lit("package").alias("source"), F.array(F.concat("path", F.lit("/**"))).alias("paths"), F.lit("medium").alias("confidence"))


def merged_subsystems(candidates: DataFrame) -> DataFrame:
    """Candidates of one id as one: paths united, the better band, the longer name (of equal ones the smaller), the smallest source."""
    best = scoring.named(F.max(scoring.ordinal(F.col("confidence"), scoring.BANDS)), scoring.BANDS)
    return candidates.groupBy("id").agg(
        F.min_by("name", F.struct((-F.length("name")).alias("n"), "name")).alias("name"), F.min("source").alias("source"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("paths")))).alias("paths"), best.alias("confidence")
    )


# -- verification --------------------------------------------------------------------


def run_recipes(recipes: DataFrame, nodes: DataFrame, edges: DataFrame, contents: DataFrame) -> DataFrame:
    """recipes with `passed`, `evidence_kind` (null: none) and `reason`.

    recipes: claim_id, place, type, symbol, from_id, to_id, path, start_line, end_line,
    pattern. nodes: id. edges (imports): src, dst. contents: path, content. An end
    that isn't given, a file that isn't there and unknown types fail without
    evidence; a span out of range fails with it.
    """
    there = nodes.select(F.col("id").alias("symbol")).distinct().withColumn("__node", F.lit(True))
    asked = recipes.filter("type = 'import_edge_check'").select("from_id", "to_id").distinct()  # the edges stay where they are: what is asked for comes to them, either way round
    turned = F.explode(F.array(F.struct(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), F.struct(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))))
    both = asked.select("from_id", "to_id", turned.alias("e")).select("from_id", "to_id", "e.src", "e.dst").join(edges.select("src", "dst"), ["src", "dst"], "left_semi")
    both = both.select("from_id", "to_id").distinct().withColumn("__edge", F.lit(True))
    text = contents.select("path", F.col("content").alias("__content"))
    r = recipes.join(there, "symbol", "left").join(both, ["from_id", "to_id"], "left").join(text, "path", "left")
    kind, content, lines = F.col("type"), F.col("__content"), F.size(F.split("__content", "\n"))
    span, inside = F.col("start_line").isNotNull() & F.col("path").isNotNull(), (F.col("start_line") >= 1) & (F.col("end_line") <= lines)
    passed = (
        F.when(kind == "source_span_check", span & content.isNotNull() & inside)
        .when(kind == "symbol_exists_check", F.col("__node").isNotNull())
        .when(kind == "import_edge_check", F.col("__edge").isNotNull())
        .when(kind == "grep_check", F.col("pattern").isNotNull() & content.isNotNull() & F.contains(content, F.col("pattern")))
        .otherwise(False)
    )
    found = F.when(kind == "source_span_check", F.when(span & content.isNotNull(), "source_span")).when(F.col("passed") & (kind == "symbol_exists_check"), "symbol_index_hit")
    found = found.when(F.col("passed") & (kind == "import_edge_check"), "static_analysis_result").when(F.col("passed") & (kind == "grep_check"), "grep_hit")
    reason = (
        F.when(F.col("passed"), F.lit(None).cast("string"))
        .when(kind == "source_span_check", F.when(~span, "No source span defined in recipe").when(content.isNull(), "File not found").otherwise("Source span out of range"))
        .when(kind == "symbol_exists_check", F.when(F.col("symbol").isNull(), "No symbol name defined in recipe").otherwise("Symbol not found in model"))
        .when(kind == "import_edge_check", F.when(F.col("from_id").isNull() | F.col("to_id").isNull(), "Missing fromPath or toPath in recipe").otherwise("Import edge not found"))
        .when(kind == "grep_check", F.when(F.col("pattern").isNull(), "No pattern defined in recipe").when(F.col("path").isNull(), "No path defined in recipe for grep check").when(content.isNull(), "File not found").otherwise("Pattern not found"))
        .otherwise("Unknown recipe type")
    )
    return r.withColumn("passed", F.coalesce(passed, F.lit(False))).withColumn("evidence_kind", found).withColumn("reason", reason).drop("__node", "__edge", "__content")


def verify(claims: DataFrame, outcomes: DataFrame, revision: str, cheapest: bool = False) -> DataFrame:
    """(claim_id, prior_status, new_status, prior_confidence, new_confidence, freshness, n_new, successor_id) of all claims.

    claims: id, status, confidence_band, freshness_band, n_supporting. What a claim had
    counts as static analysis. A failed recipe's evidence counts on both sides. With
    `cheapest` the recipes after the first failed one don't run.
    """
    if cheapest:
        stop = outcomes.filter("not passed").groupBy("claim_id").agg(F.min("place").alias("__stop"))
        outcomes = outcomes.join(stop, "claim_id", "left").filter("__stop is null or place <= __stop").drop("__stop")
    new = outcomes.filter("evidence_kind is not null").groupBy("claim_id").agg(
        F.count("*").alias("n_new"), F.max(scoring.rank(F.col("evidence_kind"))).alias("new_rank"), F.count_if(~F.col("passed")).alias("n_contra"), F.collect_set("evidence_kind").alias("kinds")
    )
    c = claims.join(new, claims["id"] == new["claim_id"], "left")
    old = F.col("n_supporting")
    zero = lambda x: F.coalesce(x, F.lit(0))
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    c = c.withColumns({
        "n_new": zero("n_new"), "n_contra": zero("n_contra"), "n_evidence": old + zero("n_new"), "n_solid": old + zero("n_new"), "n_human": F.lit(0),
        "top_rank": F.greatest(zero("new_rank"), F.when(old > 0, scoring.RANKS["static_analysis_result"]).otherwise(0)),
        "n_solid_kinds": F.size(F.array_distinct(F.when(old > 0, F.concat(kinds, F.array(F.lit("static_analysis_result")))).otherwise(kinds))),
    })
    band = scoring.named(scoring.confidence(F.col("freshness_band")), scoring.BANDS)
    return c.select(
        F.col("id").alias("claim_id"), F.col("status").alias("prior_status"), scoring.next_status(F.col("status")).alias("new_status"), F.col("confidence_band").alias("prior_confidence"), band.alias("new_confidence"),
        F.col("freshness_band").alias("freshness"), F.col("n_new").cast("long").alias("n_new"), F.concat("id", F.lit("-v-"), F.substring(F.sha2(F.concat_ws("::", "id", F.lit(revision)), 256), 1, 12)).alias("successor_id"),
    )


def apply_feedback(claims: DataFrame, feedback: DataFrame) -> DataFrame:
    """(claim_id, prior_status, new_status, new_confidence, evidence_appended, successor_id, error) of (claim_id, mode, revision) feedback.

    A confirmation or an annotation is human support, a rejection contradicts and
    rejects. claims: id, status, freshness_band, n_supporting, n_contradicting. What a
    claim had counts as static analysis. Unknown claims give an error and no evidence.
    """
    f = feedback.join(claims.withColumnRenamed("id", "claim_id"), "claim_id", "left")
    reject, old = F.col("mode") == "reject", F.coalesce("n_supporting", F.lit(0))
    human = F.when(reject, 0).otherwise(1)
    f = f.withColumns({
        "n_evidence": old + human, "n_solid": old + human, "n_human": human, "n_contra": F.coalesce("n_contradicting", F.lit(0)) + F.when(reject, 1).otherwise(0),
        "top_rank": F.when(reject, F.when(old > 0, scoring.RANKS["static_analysis_result"]).otherwise(0)).otherwise(scoring.RANKS["human_annotation"]),
        "n_solid_kinds": F.when(old > 0, 1).otherwise(0) + human,
    })
    known = F.col("status").isNotNull()
    status = F.when(reject, "rejected").otherwise(scoring.next_status(F.col("status")))
    band = scoring.named(scoring.confidence(F.col("freshness_band")), scoring.BANDS)
    return f.select(
        "claim_id", F.coalesce("status", F.lit("unknown")).alias("prior_status"), F.when(known, status).otherwise("unknown").alias("new_status"), F.when(known, band).alias("new_confidence"),
        known.alias("evidence_appended"), F.when(known, F.concat("claim_id", F.lit("-fb-"), "revision")).alias("successor_id"), F.when(~known, F.concat(F.lit("The specified claim ID does not exist in the current model: "), "claim_id")).alias("error"),
    )


def on_demand(nodes: DataFrame, kinds: list[str], existing: DataFrame) -> DataFrame:
    """(id, claim_type, node_id): claims of the kinds that the nodes don't have yet."""
    made = nodes.select(F.col("id").alias("node_id"), F.explode(F.array(*map(F.lit, kinds))).alias("claim_type"))
    made = made.select(F.concat(F.lit("claim::on-demand::"), "claim_type", F.lit("::"), "node_id").alias("id"), "claim_type", "node_id")
    return made.join(existing.select("id"), "id", "left_anti")


def custom_claim(kind: Column, statement: Column, actor: Column) -> Column:
    """A claim that a person states: a hypothesis of low confidence, surfaced, with the person's note as evidence."""
    key = F.substring(F.sha2(F.concat_ws("::", kind, statement, actor), 256), 1, 16)
    return F.struct(F.concat(F.lit("claim::custom::"), key).alias("id"), kind.alias("claim_type"), statement.alias("statement"), F.lit("hypothesis").alias("status"), F.lit("low").alias("confidence_band"), F.lit(True).alias("surfaced"), F.concat(F.lit("ev::human::"), key).alias("evidence_id"))


# -- tables ------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, kept: list[str]) -> DataFrame:
    """Claims by id: a new one replaces an old one but for the columns of `kept`."""
    n = new.select(*[F.col(c).alias(f"__{c}") for c in old.columns])
    j = old.join(n, old["id"] == n["__id"], "full_outer")
    there, before = F.col("__id").isNotNull(), F.col("id").isNotNull()
    return j.select(*[(F.when(before, F.col(c)).otherwise(F.col(f"__{c}")) if c in kept else F.when(there, F.col(f"__{c}")).otherwise(F.col(c))).alias(c) for c in old.columns])


def close(tables: dict[str, DataFrame], ids: DataFrame, revision: str) -> dict[str, DataFrame]:
    """The open rows of `ids` end at the revision, each in the first of the tables that has it."""
    out, left = {}, ids.select("id").distinct()
    for name, df in tables.items():
        here = left.join(df.filter("valid_to is null").select("id").distinct(), "id", "left_semi").withColumn("__hit", F.lit(True))
        out[name] = df.join(here, "id", "left").withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("__hit").isNotNull(), F.lit(revision)).otherwise(F.col("valid_to"))).select(df.columns)
        left = left.join(here.select("id"), "id", "left_anti")
    return out


def close_stale(df: DataFrame, repository: str, revision: str, batch: Column | None = None) -> DataFrame:
    """Open rows of a repository that this revision (or, with `batch`, this batch's timestamp) didn't write end at the revision."""
    stale = (F.col("updated_at") < batch) if batch is not None else (F.col("valid_from") < F.lit(revision))
    return df.withColumn("valid_to", F.when(F.col("valid_to").isNull() & (F.col("repository_id") == repository) & stale, F.lit(revision)).otherwise(F.col("valid_to")))


def maintain_text(index: DataFrame, nodes: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """The text index without rows of the given paths and of nodes that aren't open, then with the new rows."""
    open_ = nodes.filter("valid_to is null").select(F.col("id").alias("object_id")).distinct()
    kept = index.join(paths.select("path").distinct(), "path", "left_anti").select(index.columns)
    return kept.unionByName(new.select(index.columns)).join(open_, "object_id", "left_semi").select(index.columns)


# -- listings ---------------------------------------------------------------------------------


def scoped(scope: Column, repository: str | None = None, path: str | None = None, subsystem: str | None = None) -> Column:
    """Whether a claim's scope (JSON) lies in what is asked; one that isn't JSON does."""
    get = lambda k: F.get_json_object(scope, f"$.{k}")
    ok = F.lit(True)
    if repository:
        ok = ok & F.coalesce(get("repositoryId") == repository, F.lit(False))
    if path:
        ok = ok & F.coalesce(get("path").startswith(path), F.lit(False))
    if subsystem:
        ok = ok & F.coalesce(get("subsystemId") == subsystem, F.lit(False))
    return F.coalesce(F.try_parse_json(scope).isNull(), F.lit(True)) | ok


def uncertainties(claims: DataFrame, renames: DataFrame, partiality: DataFrame, least: str = "low") -> DataFrame:
    """(id, kind, severity) of seven kinds; claims: id, claim_type, status, confidence_band, freshness_band, valid_to; renames: src, dst; partiality: id, failed, skipped."""
    of = lambda cond, stem, kind, severity: F.when(cond, F.struct(F.concat(F.lit(stem), "id").alias("uid"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    band, status = F.col("confidence_band"), F.col("status")
    found = F.array_compact(F.array(
        of(band == "none", "unc:low-conf:", "low-confidence", "high"), of(band == "low", "unc:low-conf:", "low-confidence", "medium"),
        of((F.col("freshness_band") == "stale") | (status == "stale"), "unc:stale:", "stale", "medium"), of(status == "contradicted", "unc:contradicted:", "contradicted", "high"),
        of((F.col("claim_type") == "subsystem-owns-file") & (status == "hypothesis"), "unc:ambiguous-membership:", "ambiguous-membership", "low"),
    ))
    a = claims.filter("valid_to is null").select(F.explode(found).alias("u")).select("u.*")
    b = renames.select(F.concat(F.lit("unc:rename:"), "src", F.lit("::"), "dst").alias("uid"), F.lit("rename-candidate").alias("kind"), F.lit("medium").alias("severity"))
    empty = F.array_compact(F.array(of(F.size("failed") > 0, "unc:partiality:", "static-only-uncorroborated", "medium"), of(F.size("skipped") > 0, "unc:skipped:", "static-only-uncorroborated", "low")))
    c = partiality.select(F.explode(empty).alias("u")).select("u.*")
    return a.unionByName(b).unionByName(c).filter(scoring.importance_at_least(F.col("severity"), least)).withColumnRenamed("uid", "id")
