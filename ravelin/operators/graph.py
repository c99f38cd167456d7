"""Graph operators: one join per level, never a call per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges
from .lineage import cut, discard


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) reachable over src -> dst, seeds at depth 0; breadth first."""
    edges = cut(edges.select("src", "dst").repartition("src"))
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select(edges["dst"].alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def either_way(edges: DataFrame) -> DataFrame:
    """Edges and the same turned round; a pair may come twice."""
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")


def both_ways(edges: DataFrame) -> DataFrame:
    return either_way(edges).distinct()


def bow_tie(edges: DataFrame, node: str, max_depth: int) -> DataFrame:
    """(id, src, dst, depth): edges at the node, then edges that leave a reached end or enter a reached start."""
    level = edges.filter((F.col("src") == node) | (F.col("dst") == node)).select("id", "src", "dst").withColumn("depth", F.lit(1))
    out = level
    for d in range(2, max_depth + 1):
        prev = level.select(F.col("id").alias("pid"), F.col("src").alias("ps"), F.col("dst").alias("pd"))
        e = edges.select("id", "src", "dst")
        on = e.join(prev, e["src"] == prev["pd"]).unionByName(e.join(prev, e["dst"] == prev["ps"]))
        level = cut(on.filter("id <> pid").select("id", "src", "dst").distinct().withColumn("depth", F.lit(d)))
        out = out.unionByName(level)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node over undirected edges; labels spread and jump until they hold."""
    e = cut(both_ways(edges))
    label = cut(e.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = e.join(label, e["dst"] == label["node"]).groupBy(e["src"].alias("n")).agg(F.min("component").alias("low"))
        spread = label.join(near, label["node"] == near["n"]).select("node", F.least("component", "low").alias("c"), F.col("component").alias("old"))
        jump = spread.alias("x").join(spread.alias("y"), F.col("x.c") == F.col("y.node"), "left").select("x.node", F.coalesce("y.c", "x.c").alias("component"), "x.old")
        jump, held = cut(jump), label
        moved = not jump.filter("component <> old").isEmpty()
        discard(held)
        label = jump.select("node", "component")
        label._cut_path = jump._cut_path
        if not moved:
            return label


def fan(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) over distinct neighbours."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("fan_in"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("fan_out"))
    return into.join(out, "node", "full_outer").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def trim_acyclic(edges: DataFrame) -> DataFrame:
    """Edges that stay when nodes without predecessors or successors go, again and again: those in or between cycles."""
    return _trimmed(cut(edges.select("src", "dst").distinct()))


def _trimmed(e: DataFrame) -> DataFrame:
    """The same of a table of different edges."""
    n = e.count()
    while True:
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        e = cut(e)
        m = e.count()
        if m == n:
            return e
        n = m


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles, by forward and backward labels.

    In each round every node takes the smallest node that reaches it; nodes that
    are also reached backwards from that node within the same label are its
    strong component and leave. Self-loops count.
    """
    edges = cut(edges.select("src", "dst").distinct())
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    e, found = _trimmed(edges.filter("src <> dst")), None
    while not e.isEmpty():
        # The first labels are those of the nodes before; every node of trimmed edges has one.
        color = cut(e.groupBy(F.col("dst").alias("node")).agg(F.least(F.first("dst"), F.min("src")).alias("c")))
        while True:
            low = e.join(color, e["src"] == color["node"]).groupBy(e["dst"].alias("n")).agg(F.min("c").alias("low"))
            nxt = cut(color.join(low, color["node"] == low["n"], "left").select("node", F.least("c", F.coalesce("low", "c")).alias("c"), F.col("c").alias("old")))
            color = nxt.select("node", "c")
            if nxt.filter("c <> old").isEmpty():
                break
        inside = e.join(color.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(color.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd")
        back = cut(inside.select("src", "dst", "cs"))
        member = cut(color.filter("node = c"))
        front = member
        while not front.isEmpty():
            step = back.join(front.select(F.col("node").alias("dst"), "c"), "dst").filter("cs = c").select(F.col("src").alias("node"), "c").distinct()
            front = cut(step.join(member, ["node"], "left_anti"))
            member = member.unionByName(front)
        member = cut(member)
        sized = member.groupBy("c").agg(F.count("*").alias("k")).filter("k > 1").select("c")
        part = member.join(sized, "c").select("node", F.col("c").alias("component"))
        found = part if found is None else found.unionByName(part)
        gone = member.select("node")
        e = _trimmed(cut(e.join(gone, e["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti")))
    if found is None:
        return loops
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def blast(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, distance, via_uncertain) around the seeds; edges: id, kind, src, dst, uncertain.

    A node takes over its finder's uncertainty and that of the edge by which it is found
    first: finders in the order they were found, then edges by source, kind, target
    and id. It is reported uncertain if any edge scanned at it, from a node nearer than
    max_depth, or that edge's other end, is.
    """
    e = edges.select("id", "kind", "src", "dst", F.coalesce("uncertain", F.lit(True)).alias("uncertain"))
    ends = cut(e.select("*", F.col("src").alias("at"), F.col("dst").alias("to")).unionByName(e.filter("src <> dst").select("*", F.col("dst").alias("at"), F.col("src").alias("to"))).repartition("at"))
    front = cut(ranges.numbered(seeds.select("node").distinct(), ["node"], "pos").withColumn("taken", F.lit(False)))
    seen, marks = front.select("node", F.lit(0).alias("distance"), F.lit(False).alias("via")), None
    for depth in range(1, max_depth + 1):
        scanned = cut(front.join(ends, front["node"] == ends["at"]).select("to", "pos", "src", "kind", "dst", "id", (F.col("taken") | F.col("uncertain")).alias("via")))
        here = scanned.groupBy(F.col("to").alias("node")).agg(F.max("via").alias("via"))
        marks = here if marks is None else marks.unionByName(here)
        order = F.struct("pos", "src", "kind", "dst", "id")
        found = scanned.groupBy(F.col("to").alias("node")).agg(F.min(order).alias("by"), F.min_by("via", order).alias("taken"))
        found = found.join(seen, "node", "left_anti").select("node", "taken", "by.*")
        front = cut(ranges.numbered(found.select("node", "taken", F.col("pos").alias("before"), "src", "kind", "dst", "id"), ["before", "src", "kind", "dst", "id", "node"], "pos").select("node", "pos", "taken"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("node", F.lit(depth).alias("distance"), F.col("taken").alias("via")))
    if marks is None:
        return seen.withColumnRenamed("via", "via_uncertain")
    rep = marks.groupBy("node").agg(F.max("via").alias("any"))
    return seen.join(rep, "node", "left").select("node", "distance", (F.col("via") | F.coalesce("any", F.lit(False))).alias("via_uncertain"))


def risky(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Uncertain edges at any of the nodes; near: node."""
    unsure = edges.filter(F.coalesce("uncertain", F.lit(True)))
    return unsure.join(near, unsure["src"] == near["node"], "left_semi").unionByName(unsure.join(near, unsure["dst"] == near["node"], "left_semi")).distinct()


def trace(edges: DataFrame, start, targets: DataFrame, max_depth: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """(step, src, dst, kind, id) of a shortest way, either way along edges, from start to the first target found; without a way no row.

    Of several finders of a node the first found counts, then the edge's source, kind,
    target and id. A start that is a target itself isn't found.
    """
    e = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
    e = e.filter("src <> dst").select("id", "kind", "src", "dst")
    ends = cut(e.select("*", F.col("src").alias("at"), F.col("dst").alias("to")).unionByName(e.select("*", F.col("dst").alias("at"), F.col("src").alias("to"))).repartition("at"))
    spark = edges.sparkSession
    front = cut(spark.createDataFrame([(start, 1)], f"node {edges.schema['src'].dataType.simpleString()}, pos long"))
    seen, levels, goal = front.select("node"), [], None
    wanted = targets.select(F.col("node").alias("goal")).distinct()
    for _ in range(max_depth):
        step = front.join(ends, front["node"] == ends["at"]).select("to", "pos", F.col("node").alias("parent"), "src", "kind", "dst", "id")
        order = F.struct("pos", "src", "kind", "dst", "id")
        found = step.groupBy(F.col("to").alias("node")).agg(F.min(order).alias("by"), F.min_by("parent", order).alias("parent")).join(seen, "node", "left_anti")
        found = found.select("node", "parent", F.col("by.pos").alias("before"), "by.src", "by.kind", "by.dst", "by.id")
        level = cut(ranges.numbered(found, ["before", "src", "kind", "dst", "id", "node"], "pos"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("node"))
        hit = level.join(wanted, level["node"] == wanted["goal"]).orderBy("pos").select("node").first()
        if hit is not None:
            goal = hit["node"]
            break
        front = level.select("node", "pos")
    rows, here = [], goal
    for n in range(len(levels), 0, -1):  # one row a level
        if goal is None:
            break
        r = levels[n - 1].filter(F.col("node") == F.lit(here)).select("parent", "kind", "id").first()
        rows.append((n, r["parent"], here, r["kind"], r["id"]))
        here = r["parent"]
    node = edges.schema["src"].dataType.simpleString()
    return spark.createDataFrame(rows[::-1], f"step int, src {node}, dst {node}, kind string, id string")


def cycle_paths(edges: DataFrame, component: DataFrame) -> DataFrame:
    """(component, place, node): for each strong component a shortest cycle through its smallest node, that node first and last.

    All components search at once, a level a join. component: node, component.
    """
    member = cut(component)
    e = edges.select("src", "dst").distinct()
    inside = e.join(member.select(F.col("node").alias("src"), F.col("component").alias("c1")), "src").join(member.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst").filter("c1 = c2")
    inside = cut(inside.select(F.col("c1").alias("component"), "src", "dst").repartition("component", "src"))
    heads = member.groupBy("component").agg(F.min("node").alias("head"))
    front = cut(heads.select("component", "head", F.col("head").alias("node"), F.array("head").alias("way")))
    seen, done = front.select("component", "node"), None
    while True:
        step = front.join(inside, (front["component"] == inside["component"]) & (front["node"] == inside["src"])).select(front["component"], "head", "way", "dst")
        step = cut(step.groupBy("component", "head", "dst").agg(F.min("way").alias("way")))
        closed = step.filter("dst = head").select("component", F.concat("way", F.array("dst")).alias("way"))
        done = closed if done is None else done.unionByName(closed.join(done.select("component"), "component", "left_anti"))
        front = step.filter("dst <> head").join(done.select("component"), "component", "left_anti").withColumnRenamed("dst", "node")
        front = cut(front.join(seen, ["component", "node"], "left_anti").select("component", "head", "node", F.concat("way", F.array("node")).alias("way")))
        if front.isEmpty():
            return done.select("component", F.posexplode("way").alias("place", "node"))
        seen = seen.unionByName(front.select("component", "node"))
        done = cut(done)


def between(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges with both ends reached."""
    r = reached.select("node")
    return edges.join(r, edges["src"] == r["node"], "left_semi").join(r, F.col("dst") == r["node"], "left_semi")


def scoped(edges: DataFrame, scope: str | None, nodes: DataFrame) -> DataFrame:
    """All edges (no scope or `*`), those at the node of that id, else those whose ends have `::scope` in their ids."""
    if not scope or scope == "*":
        return edges
    if not nodes.filter(F.col("id") == scope).isEmpty():
        return edges.filter((F.col("src") == scope) | (F.col("dst") == scope))
    return edges.filter(F.contains("src", F.lit(f"::{scope}")) | F.contains("dst", F.lit(f"::{scope}")))


def metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, distinct edges, largest fans and the average fan out, over all nodes, to two places."""
    f = fan(edges)
    return f.agg(
        F.count("*").alias("total_nodes"), F.coalesce(F.sum("fan_out"), F.lit(0)).alias("total_edges"), F.coalesce(F.max("fan_in"), F.lit(0)).alias("max_fan_in"),
        F.coalesce(F.max("fan_out"), F.lit(0)).alias("max_fan_out"), F.coalesce(F.round(F.sum("fan_out") / F.count("*"), 2), F.lit(0.0)).alias("avg_fan_out"),
    )
