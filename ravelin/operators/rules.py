"""Architecture rules as data: boundaries, forbidden imports, dependency candidates.

Rules and boundaries are small configuration: their patterns become one column
expression each, so every edge is read once, whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob


@dataclass
class Boundary:
    name: str
    paths: list[str]
    public: list[str] = field(default_factory=list)
    allowed: list[str] | None = None


@dataclass
class Rule:
    id: str
    name: str
    source: str  # pattern of the importing side
    target: str
    severity: str = "error"
    status: str = "human_confirmed_explicit"
    origin: str = "explicit"
    enabled: bool = True


def explicit(repository: str, definitions: list[dict]) -> list[Rule]:
    """Rules from configuration; disabled ones are left out before they are numbered."""
    on = [d for d in definitions if d.get("enabled", True)]
    return [Rule(f"rule-explicit-{repository}-{i}-{d['name']}", d["name"], d["from"], d["to"], d.get("severity", "error")) for i, d in enumerate(on)]


def enforceable(rules: list[Rule]) -> list[Rule]:
    """The rules, if all are explicit and confirmed; an inferred one among them is an error."""
    for r in rules:
        if r.status != "human_confirmed_explicit" or r.origin != "explicit":
            raise ValueError(f"rule {r.id} is not confirmed ({r.status}, {r.origin})")
    return rules


def _any(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | glob(path, g)
    return out


def membership(files: DataFrame, boundaries: list[Boundary], path: str = "path") -> DataFrame:
    """files with `boundary` (the first whose paths fit, else null), `is_public` and `several` (a second one fits too).

    Of boundaries with one name the first counts.
    """
    first: dict[str, Boundary] = {}
    for b in boundaries:
        first.setdefault(b.name, b)
    p, name, public, n = F.col(path), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(0)
    for b in reversed(first.values()):
        fits = _any(p, b.paths)
        name, public, n = F.when(fits, b.name).otherwise(name), F.when(fits, _any(p, b.public)).otherwise(public), n + fits.cast("int")
    return files.withColumns({"boundary": name, "is_public": public, "several": n > 1})


def joined(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(from_path, to_path) edges with the membership of both ends; files: path, boundary, is_public."""
    side = lambda s: files.select(F.col("path").alias(f"{s}_path"), F.col("boundary").alias(f"{s}_boundary"), F.col("is_public").alias(f"{s}_public"))
    return edges.join(side("from"), "from_path", "left").join(side("to"), "to_path", "left")


def fits(side: str, pattern: str) -> Column:
    """A glob, or `boundary:<name>` with an optional `:internal`; another suffix is part of the name."""
    if not pattern.startswith("boundary:"):
        return F.coalesce(glob(F.col(f"{side}_path"), pattern), F.lit(False))
    name = pattern.removeprefix("boundary:")
    inside = name.endswith(":internal") and len(name) > len(":internal")
    here = F.col(f"{side}_boundary") == name.removesuffix(":internal") if inside else F.col(f"{side}_boundary") == name
    return F.coalesce(here & ~F.col(f"{side}_public") if inside else here, F.lit(False))


def in_scope(path: str | None) -> Column:
    """Either end below the path; null or an empty path: all."""
    return F.col("from_path").startswith(path) | F.col("to_path").startswith(path) if path else F.lit(True)


def forbidden(edges: DataFrame, rules: list[Rule], scope: str | None = None) -> DataFrame:
    """(rule_id, rule_name, from_path, to_path, severity): one row for each rule that an edge breaks. edges: as `joined` gives them."""
    found = [F.when(fits("from", r.source) & fits("to", r.target), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"))) for r in enforceable(rules)]
    broken = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<rule_id:string,rule_name:string,severity:string>>")
    return edges.filter(in_scope(scope)).select("from_path", "to_path", F.explode(broken).alias("r")).select("r.rule_id", "r.rule_name", "from_path", "to_path", "r.severity")


def between_boundaries(edges: DataFrame, boundaries: list[Boundary], scope: str | None = None) -> DataFrame:
    """The same columns for edges between boundaries: a dependency that isn't allowed, and a target that isn't public."""
    a, b = F.col("from_boundary"), F.col("to_boundary")
    denied = F.lit(False)
    for x in boundaries:
        if x.allowed is not None:
            denied = denied | ((a == x.name) & (~b.isin(*x.allowed) if x.allowed else F.lit(True)))
    kind = lambda cond, rid, name: F.when(cond, F.struct(rid.alias("rule_id"), name.alias("rule_name"), F.lit("warning").alias("severity")))
    both = F.array_compact(F.array(
        kind(denied, F.concat(F.lit("boundary:"), a, F.lit(":disallowed-dep:"), b), F.concat(F.lit("boundary-dependency:"), a, F.lit("->"), b)),
        kind(~F.col("to_public"), F.concat(F.lit("boundary:"), b, F.lit(":non-public-import")), F.concat(F.lit("boundary-violation:"), a, F.lit("->"), b)),
    ))
    across = edges.filter(in_scope(scope)).filter(a.isNotNull() & b.isNotNull() & (a != b))
    return across.select("from_path", "to_path", F.explode(both).alias("r")).select("r.rule_id", "r.rule_name", "from_path", "to_path", "r.severity")


def checks_between(edges: DataFrame, scope: str | None = None) -> DataFrame:
    """One row: edges between boundaries, which count as checks beside the rules."""
    return edges.filter(in_scope(scope)).agg(F.count_if(F.col("from_boundary") != F.col("to_boundary")).alias("checks"))


def layer_candidates(declared: DataFrame, imports: DataFrame) -> DataFrame:
    """(a, b, exceptions): b must not import a where a is declared to depend on b and not the other way round;
    observed imports against it are its known exceptions. declared: a, b; imports: a, b, id."""
    back = declared.select(F.col("b").alias("a"), F.col("a").alias("b"))
    one_way = declared.filter("a <> b").distinct().join(back.distinct(), ["a", "b"], "left_anti")
    against = imports.select(F.col("b").alias("a"), F.col("a").alias("b"), "id")
    return one_way.join(against, ["a", "b"], "left").groupBy("a", "b").agg(F.count("id").alias("exceptions"))
