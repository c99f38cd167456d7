"""URL verdicts by rules and by a tree of path templates per host.

Rules (host, path prefix, verdict) fit a host and its subdomains; the longest
that fits decides. For other urls templates decide:

* Variable segments become wildcards: numbers `{n}`, hexadecimal ids `{h}`, other
  words with digits `{x}`, and, level by level, the literal segments under a node
  that has at least VARIED different ones with fewer than REPEAT urls each: `*`.
  What lies beyond DEPTH segments is one wildcard `**`.
* Statistically similar siblings merge into `{~}`. A branch's kinds are the numbers
  of segments left below it, each with the form of the next one. Siblings with the
  same kinds are pooled; a branch merges with its pool if its share of each kind and,
  where it has labels, its block rate don't differ significantly from the pool's
  (z-tests at Z). So a branch without labels takes those of branches like it.
* Labels are the rules' own verdicts. A node's purity is
  (blocked + WEIGHT * outside) / (labelled + WEIGHT), where `outside` is the same for
  its parent without the node's own labels, and PRIOR for a host. So labels reach what
  they don't cover, the less the further away, and none counts twice. A template is
  the node where a path ends; with a purity of REJECT or more it is blocked.

All counts run over all urls and are added up before each shuffle; a host with a
third of all rows is one row per template and task. Null urls and urls without
`://` have an empty host and path and are allowed. Repeated rows get a row each;
an empty table gives an empty table; other columns stay out, whatever their names.
Very long urls are cut by DEPTH in the tree alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DEPTH, VARIED, REPEAT, Z = 6, 16, 4.0, 1.96
PRIOR, WEIGHT, REJECT = 0.2, 4.0, 0.5
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, _UP, _LOW), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """Segments with their variable parts by form; a file's ending stays."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")

    def form(s):
        stem, end = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        kind = (
            F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}"))
            .when(stem.rlike(r"^[0-9A-Fa-f-]{8,}$") & stem.rlike("[0-9]"), F.lit("{h}"))
            .when(stem.rlike("[0-9]"), F.lit("{x}"))
            .otherwise(stem)
        )
        return F.concat(kind, end)

    shaped = F.transform(parts, form)
    return F.when(F.size(shaped) > DEPTH, F.concat(F.slice(shaped, 1, DEPTH), F.array(F.lit("**")))).otherwise(shaped)


def form_of(segment: Column) -> Column:
    """A segment's wildcard without its ending; `w` for a literal, nothing for none."""
    return F.when(segment.isNull(), "").when(segment.rlike(r"^(\{[nhx]\}|\*\*)"), F.regexp_extract(segment, r"^(\{[nhx]\}|\*\*)", 1)).otherwise("w")


def _differs(share: Column, among: Column, pooled: Column, size: Column) -> Column:
    """Whether a share among some differs significantly from a pooled share among `size`."""
    return F.abs(share - pooled) > Z * F.sqrt(F.greatest(pooled * (1 - pooled), 1 / size) / among)


def _merging(part: DataFrame) -> DataFrame:
    """(host, template, child) of the branches that merge with siblings."""
    node, branch = ["host", "template"], ["host", "template", "child"]
    kinds = part.groupBy(*branch, "kind").agg(*(F.sum(c).alias(c) for c in ("n", "lab", "blk")))
    whole = kinds.groupBy(*branch).agg(F.array_join(F.array_sort(F.collect_list("kind")), "|").alias("shape"), *(F.sum(c).alias(f"b_{c}") for c in ("n", "lab", "blk")))
    pool = whole.groupBy(*node, "shape").agg(F.count("*").alias("members"), *(F.sum(f"b_{c}").alias(f"p_{c}") for c in ("n", "lab", "blk"))).filter("members > 1")
    pooled = whole.join(pool, [*node, "shape"])
    other_rate = (F.col("b_lab") > 0) & _differs(F.col("b_blk") / F.when(F.col("b_lab") > 0, F.col("b_lab")), F.col("b_lab"), F.col("p_blk") / F.col("p_lab"), F.col("p_lab"))
    pooled = pooled.filter(~F.coalesce(other_rate, F.lit(False)))
    rows = kinds.select(*branch, "kind", "n").join(pooled.select(*branch, "shape", "b_n", "p_n"), branch)
    of_kind = kinds.select(*branch, "kind", "n").join(whole.select(*branch, "shape"), branch).groupBy(*node, "shape", "kind").agg(F.sum("n").alias("k_n"))
    rows = rows.join(of_kind, [*node, "shape", "kind"])
    other = _differs(F.col("n") / F.col("b_n"), F.col("b_n"), F.col("k_n") / F.col("p_n"), F.col("p_n"))
    return rows.groupBy(*branch).agg(F.max(other).alias("other")).filter("not other").select(*branch)


def templates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows: host, segs, verdict (null: unlabelled) -> (host, segs, template, purity)."""

    def counted(t: DataFrame) -> DataFrame:
        """t with each row's node's labels and what its parent, of which t has them before, says without these."""
        at = t.groupBy("host", "template").agg(F.sum("lab").alias("lab_"), F.sum("blk").alias("blk_"))
        lab, blk = (F.coalesce(f"node_{c}", f"{c}_") for c in ("lab", "blk"))
        outside = (blk - F.col("blk_") + WEIGHT * F.col("outside")) / (lab - F.col("lab_") + WEIGHT)
        t = t.join(at, ["host", "template"]).withColumn("outside", outside)
        return t.withColumns({"node_lab": F.col("lab_"), "node_blk": F.col("blk_")}).select(columns)

    columns = ["host", "segs", "n", "lab", "blk", "template", "outside", "node_lab", "node_blk"]
    table = rows.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count("verdict").alias("lab"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).cast("long").alias("blk")
    )
    none = F.lit(None).cast("long")
    table = scratch.keep(counted(table.withColumns({"template": F.lit(""), "outside": F.lit(PRIOR), "node_lab": none, "node_blk": none})))
    deepest = table.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(deepest):
        inside = F.size("segs") > d
        kind = F.concat((F.size("segs") - d - 1).cast("string"), form_of(F.get("segs", F.lit(d + 1))))
        part = table.filter(inside).select("*", F.col("segs")[d].alias("child"), kind.alias("kind"))
        child = part.groupBy("host", "template", "child").agg(F.sum("n").alias("n"))
        literal = ~F.col("child").rlike(r"^(\{[nhx]\}|\*\*)")
        node = child.filter(literal).groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"))
        wild = node.filter((F.col("kinds") >= VARIED) & (F.col("total") < REPEAT * F.col("kinds"))).select("host", "template", F.lit(True).alias("wild"))
        part = part.join(wild, ["host", "template"], "left").withColumn("child", F.when(F.coalesce("wild", F.lit(False)) & literal, F.lit("*")).otherwise(F.col("child"))).drop("wild")
        merged = _merging(part).withColumn("merged", F.lit(True))
        part = part.join(merged, ["host", "template", "child"], "left").withColumn("child", F.when(F.coalesce("merged", F.lit(False)), F.lit("{~}")).otherwise(F.col("child")))
        part = counted(part.withColumn("template", F.concat("template", F.lit("/"), "child")))
        old, table = table, scratch.keep(part.unionByName(table.filter(~inside)))
        scratch.drop(old)
    return table.select("host", "segs", "template", ((F.col("node_blk") + WEIGHT * F.col("outside")) / (F.col("node_lab") + WEIGHT)).alias("purity"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) per row; template and purity where no rule fits."""
    scratch = Scratch(pages.sparkSession)
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", name.alias("rule"), verdict.alias("by_rule"), segments(F.col("path")).alias("segs"))
    tree = templates(base.select("host", "segs", F.col("by_rule").alias("verdict")), scratch)
    open_ = base.filter("rule is null")
    judged = open_.join(tree, ["host", "segs"], "left").select(
        "page_id", "host", "path", "rule", F.when(F.col("purity") >= REJECT, "block").otherwise("allow").alias("verdict"), "template", "purity"
    )
    ruled = base.filter("rule is not null").select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity"))
    return judged.unionByName(ruled).withColumnRenamed("page_id", page_id)
