"""Similarity join of documents on word shingles, by signature trees.

A document's set holds its distinct runs of k words (A-Z lower-cased; a shorter
text is one run). Two documents link when |a & b| / |a | b| reaches a threshold.

1. Documents with equal sets are one class; its smallest doc_id stands for it.
2. Routing. ROUTES keys per set, each the smallest of its shingle hashes under a salt,
   bring linked documents together: two sets of likeness J share no key with
   probability (1 - J) ** ROUTES, 7e-14 at 0.85 and 7e-12 at 0.8.
3. Trees. Under each key a tree over the members in order of size; a node holds
   the OR of its members' token bitmaps, their range of sizes, and the largest
   number of tokens that a member has beyond its bits. Two nodes are visited
   together; a pair of nodes goes when the sizes exclude a link or when
   bits in common + least excess, the most that any two members can share, is
   less than a link needs.
4. The first traversal joins what may be alike and skips what is joined already,
   so a group of n near copies gives n - 1 pairs, not n * n. Pairs are verified
   on their texts. The second traversal visits only keys whose members are still
   in several components, and gives every pair of documents in different ones
   that the bound allows; these are verified too. After it no pair that could
   link two components is left.

5. Links. All links are inside components. Two classes in one have one link; of
   more, every pair is compared on its texts, block against block, and counted.

A key with more than BLOCK members is dealt into blocks: in the first traversal
each block with the group's smallest id, in the second every pair of blocks that
holds different components.

Null and empty texts have an empty set and no links. Rows that share a doc_id
are one document. Rows without a doc_id link with nothing and have a null
component. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, TextHasher, arrow_list, components, mix, rolling, signed

ROUTES = 16
BITS = 2048
BLOCK = 1024
LEAF = 8
WORDS = 4_000_000  # shingles of a block of a component, on average at most
COLUMNS = 2048


def shingles(hasher: TextHasher, text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of the whole sequence if it is shorter."""
    words = hasher(text)
    if not len(words):
        return words
    runs = np.sort(rolling(words, min(k, len(words))) ^ np.uint64(0 if len(words) >= k else len(words)))
    return runs[np.concatenate(([True], runs[1:] != runs[:-1]))]


def routes(s: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The smallest of the set's hashes under each salt; the hashes are mixed already, so an odd factor re-orders them."""
    least = np.full(len(salts), np.iinfo(np.uint64).max)
    for lo in range(0, len(s), 4096):
        np.minimum(least, (s[lo : lo + 4096] * salts[:, None]).min(1), out=least)
    return mix(least ^ salts)


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(s >> np.uint64(17)).astype(np.int64) % BITS] = 1
    return np.packbits(bits).view(np.uint64)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    salts = mix(np.arange(1, ROUTES + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        hasher = TextHasher(fold=True)
        for batch in batches:
            n, s1, s2, keys, sizes, sigs = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(hasher, text, k)
                n.append(len(s))
                s1.append(int(mix(s).sum(dtype=np.uint64)) if len(s) else 0)
                s2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0)
                if len(s):
                    keys.append(routes(s, salts))
                    sizes.append(ROUTES)
                    sigs.append(bitmap(s).tobytes())
                else:
                    sizes.append(0)
                    sigs.append(b"")
            flat = signed(np.concatenate(keys)) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(signed(np.array(s1, np.uint64))), pa.array(signed(np.array(s2, np.uint64))), arrow_list(flat, sizes), pa.array(sigs, pa.binary())],
                names=["doc_id", "n", "s1", "s2", "keys", "sig"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>, sig binary")


class Tree:
    """Nodes level by level; members in order of size, FAN of them under a node."""

    FAN = 8

    def __init__(self, n: np.ndarray, sig: np.ndarray):
        excess = n - np.bitwise_count(sig).sum(1)
        self.levels = [(sig, n, n, excess)]
        while len(self.levels[-1][1]) > 1:
            s, lo, hi, e = self.levels[-1]
            at = np.arange(0, len(lo), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(s, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(e, at)))

    def may_link(self, level: int, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether members under nodes x and y can link, by sizes and by the most they can share."""
        s, lo, hi, e = self.levels[level]
        ok = (den * hi[x] >= num * lo[y]) & (den * hi[y] >= num * lo[x])
        most = np.bitwise_count(s[x] & s[y]).sum(1) + np.minimum(e[x], e[y])
        return ok & ((num + den) * most >= num * (lo[x] + lo[y]))


def traverse(rep: np.ndarray, n: np.ndarray, sig: np.ndarray, label: np.ndarray, num: int, den: int, joining: bool) -> list[tuple[int, int]]:
    """Pairs of members under different labels that may link.

    joining: labels merge as pairs are found, so each joined set gives a tree of pairs.
    """
    order = np.lexsort((rep, n))
    rep, n, sig, label = rep[order], n[order], sig[order], label[order].copy()
    tree, pairs = Tree(n, sig), []

    def take(x: np.ndarray, y: np.ndarray) -> None:
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if label[i] != label[j]:
                pairs.append((min(int(rep[i]), int(rep[j])), max(int(rep[i]), int(rep[j]))))
                if joining:
                    label[label == max(label[i], label[j])] = min(label[i], label[j])

    if joining:  # the smallest id first: most near copies join it
        hub = int(np.argmin(rep))
        rest = np.flatnonzero(label != label[hub])
        rest = rest[tree.may_link(0, np.full(len(rest), hub), rest, num, den)]
        take(np.full(len(rest), hub), rest)
    fan, top = Tree.FAN, len(tree.levels) - 1
    x = y = np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        at = np.arange(0, len(rep), fan**level)
        low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
        ok = ~((low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y]))
        x, y = x[ok], y[ok]
        hit = np.zeros(len(x), bool)
        for lo in range(0, len(x), 65_536):
            hit[lo : lo + 65_536] = tree.may_link(level, x[lo : lo + 65_536], y[lo : lo + 65_536], num, den)
        x, y = x[hit], y[hit]
        if level:
            below = len(tree.levels[level - 1][1])
            cx = (x[:, None] * fan + np.arange(fan))[:, :, None].repeat(fan, 2)
            cy = (y[:, None] * fan + np.arange(fan))[:, None, :].repeat(fan, 1)
            ok = (cx < below) & (cy < below) & ((cx < cy) if level == 1 else (cx <= cy))
            x, y = cx[ok], cy[ok]
    if top == 0:
        return pairs
    take(x, y)
    return pairs


def _traversal(rows: DataFrame, num: int, den: int, joining: bool) -> DataFrame:
    """rows: group, key order irrelevant; (g long, h long, rep, n, sig, label). Groups are at most two blocks."""
    parts = rows.repartition("g", "h").sortWithinPartitions("g", "h")

    def run(batches):
        def done(buf):
            rep, n, sig, label = (np.concatenate(c) for c in zip(*buf, strict=True))
            _, at = np.unique(rep, return_index=True)
            return traverse(rep[at], n[at], sig[at], label[at], num, den, joining) if len(at) > 1 else []

        last, buf = None, []
        for batch in batches:
            g, h, rep, n, label = (np.asarray(batch.column(c)) for c in ("g", "h", "rep", "n", "label"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            cut = np.flatnonzero((np.diff(g) != 0) | (np.diff(h) != 0)) + 1
            edges = [0, *cut.tolist(), len(g)]
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                if last is not None and last != (g[a], h[a]):
                    out += done(buf)
                    buf = []
                last = (g[a], h[a])
                buf.append((rep[a:b], n[a:b], sig[a:b], label[a:b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])
        if buf and (out := done(buf)):
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return parts.mapInArrow(run, "a long, b long").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )

    def run(batches):
        hasher = TextHasher(fold=True)
        for batch in batches:
            seen: dict[int, np.ndarray] = {}
            keep = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sa, sb = (shingles(hasher, t, k) if (i not in seen) else seen[i] for i, t in ((a, ta), (b, tb)))
                seen = {a: sa, b: sb}
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(den * common >= num * (len(sa) + len(sb) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def count_links(x: list[np.ndarray], y: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set of x and of each of y between the two; y None: among x, each pair counted at both ends."""
    sets = x if y is None else x + y
    n, a = np.array([len(s) for s in sets]), len(x)
    row = np.repeat(np.arange(len(sets)), n)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[col]
    row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((a, a if y is None else len(y)), np.int64)
    for lo in range(0, int(shared.sum()), COLUMNS):
        at = slice(*np.searchsorted(col, [lo, lo + COLUMNS]))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[at], col[at] - lo] = 1
        common += (m[:a] @ (m if y is None else m[a:]).T).astype(np.int64)
    linked = (common > 0) & (den * common >= num * (n[:a, None] + (n if y is None else n[a:])[None, :] - common))
    if y is None:
        np.fill_diagonal(linked, False)
    return linked.sum(1), linked.sum(0)


def _degrees(scratch: Scratch, comp: DataFrame, reps: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, n_links): the classes that each class in a component links with."""
    rows = comp.join(reps.select(F.col("doc_id").alias("node"), "n"), "node")
    sized = scratch.keep(rows.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("words")))
    pairs = comp.join(sized.filter("c = 2"), "component").select("node", F.lit(1).cast("long").alias("n_links"))
    m = F.least("c", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("words") / WORDS))).cast("long")
    larger = comp.join(sized.filter("c > 2").select("component", m.alias("m")), "component")
    larger = larger.join(texts.select(F.col("doc_id").alias("node"), "text").dropDuplicates(["node"]), "node").withColumn("i", F.pmod(F.xxhash64("node"), F.col("m")))
    blocks = larger.select("component", "node", "text", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j"))
    blocks = blocks.select("component", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "node", "i", "text")
    parts = blocks.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")

    def run(batches):
        def done(key, buf):
            _, x, y = key
            ours, theirs = [b for b in buf if b[1] == x], [b for b in buf if b[1] == y]
            if x == y:
                return [(b[0], int(d)) for b, d in zip(ours, count_links([b[2] for b in ours], None, num, den)[0], strict=True)]
            if not ours or not theirs:
                return []
            one, two = count_links([b[2] for b in ours], [b[2] for b in theirs], num, den)
            return [(b[0], int(d)) for b, d in zip(ours + theirs, [*one, *two], strict=True)]

        hasher, last, buf = TextHasher(fold=True), None, []
        for batch in batches:
            out = []
            for g, x, y, node, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None and last != (g, x, y):
                    out += done(last, buf)
                    buf = []
                last = (g, x, y)
                buf.append((node, i, shingles(hasher, text, k)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["node", "n_links"])
        if buf and (out := done(last, buf)):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["node", "n_links"])

    counted = parts.mapInArrow(run, "node long, n_links long")
    degrees = scratch.keep(pairs.unionByName(counted).groupBy("node").agg(F.sum("n_links").alias("n_links")))
    scratch.drop(sized)
    return degrees


def join_components(docs: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text", count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row; links where |a & b| / |a | b| >= num / den.

    n_links is the number of other classes, of texts with a different set, that the
    row's class links with; equal sets add none. Without `count` there is no n_links.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = scratch.keep(_sets(base, k))
    classes = sets.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    member = sets.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.col("rep")))
    reps = sets.join(classes.select("n", "s1", "s2", F.col("rep").alias("doc_id")), ["n", "s1", "s2", "doc_id"]).dropDuplicates(["doc_id", "s1", "s2", "n"])

    rows = reps.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("hub"), F.max("rep").alias("top")).filter("hub < top")
    groups = scratch.keep(groups)  # so the join below shuffles both sides and can split a hot key
    shared = scratch.keep(rows.join(groups.select("key", "c", "hub"), "key"))
    sigs = reps.select(F.col("doc_id").alias("rep"), "n", "sig")
    wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = scratch.keep(base.join(wanted, "doc_id", "left_semi"))

    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / BLOCK)).cast("long")
    hubs = groups.select("key", F.col("hub").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("c") / BLOCK) - 1).cast("long"))).alias("h"))
    first = shared.select(F.col("key").alias("g"), block.alias("h"), "rep").unionByName(hubs.select(F.col("key").alias("g"), "h", "rep"))
    first = first.join(sigs, "rep").withColumn("label", F.col("rep"))
    pairs = scratch.keep(_traversal(first, num, den, True))
    scratch.drop(groups)
    links = scratch.keep(_verify(pairs, texts, k, num, den))
    scratch.drop(pairs)
    comp = components(scratch, links)

    # keys whose members are still apart
    labelled = shared.select("key", "rep", "c").join(comp, F.col("rep") == F.col("node"), "left").select("key", "rep", "c", F.coalesce("component", "rep").alias("label"))
    apart = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    open_rows = labelled.join(apart, "key").select("key", "rep", "label", F.ceil(F.col("c") / BLOCK).cast("long").alias("m"), block.alias("i"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))
    second = open_rows.select("key", "rep", "label", "m", "i", at.alias("j")).select(
        F.col("key").alias("g"), (F.least("i", "j") * F.col("m") + F.greatest("i", "j")).alias("h"), "rep", "label"
    )
    pairs2 = scratch.keep(_traversal(second.join(sigs, "rep"), num, den, False))
    scratch.drop(shared, comp)
    links2 = scratch.keep(_verify(pairs2, texts, k, num, den))
    scratch.drop(pairs2)
    comp = components(scratch, links.unionByName(links2))
    scratch.drop(links, links2)
    known, columns = comp, ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")]
    if count:
        known = comp.join(_degrees(scratch, comp, reps, texts, k, num, den), "node", "left")
        columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = member.join(known, member["rep"] == known["node"], "left").select(*columns)
    scratch.drop(texts)
    return out
