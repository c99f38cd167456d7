"""Text, vector and hybrid retrieval."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Letters with accents and the letters that they are without.
_ACCENTED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii()}


def folded(text: Column) -> Column:
    """Lower case without accents."""
    plain = F.translate(F.lower(text), "".join(_ACCENTED), "".join(_ACCENTED.values()))
    return F.lower(F.regexp_replace(plain, r"[\u0300-\u036f]", ""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def terms_of(query: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return [t for t in re.split(r"[\W_]+", plain) if t]


def _holds(text: Column, terms: list[str]) -> Column:
    padded = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return F.coalesce(padded.contains(" " + " ".join(terms) + " "), F.lit(False))


def phrase(docs: DataFrame, query: str, text: str = "text", path: str | None = None) -> DataFrame:
    """Rows whose text (or path) holds the query's tokens side by side, accents aside; operators in the query are words."""
    terms = terms_of(query)
    if not terms:
        return docs.limit(0)
    return docs.filter(reduce(lambda a, b: a | b, [_holds(F.col(c), terms) for c in (text, path) if c]))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf, len): the index that `ranked` reads; written once, by term, a query reads its terms' part only."""
    words = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t")).select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return words.groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"))


def ranked(index: DataFrame, terms: list[str], n: int, avgdl: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of BM25 over postings; n documents of avgdl words on average."""
    mine = index.filter(F.col("term").isin(*terms))
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avgdl)))
    return mine.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(score).alias("score"))  # df: a row a term


def bm25(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of documents with any of the terms; one pass counts, one row of totals."""
    hits = lambda q: F.size(F.filter("t", lambda x: x == q))
    counted = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t")).select("doc_id", F.size("t").alias("len"), *[hits(q).alias(f"tf{i}") for i, q in enumerate(terms)])
    total = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0
    return counted.filter(hit).crossJoin(F.broadcast(total)).select("doc_id", score.alias("score"))  # totals: one row


def cosine(a: Column, b: Column) -> Column:
    x, y = (F.transform(v, lambda e: e.cast("double")) for v in (a, b))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    size = norm(x) * norm(y)
    return F.when(size > 0, dot / size).otherwise(0.0)


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Exact cosine of all rows; the k best, ties by id."""
    q = F.array(*[F.lit(float(v)) for v in query])
    return vectors.select(id_col, cosine(F.col(vec), q).alias("score")).orderBy(F.desc("score"), id_col).limit(max(0, k))


def merge_ranks(anchors: DataFrame) -> DataFrame:
    """(id, source, rank): the best rank per id, ties to the earlier stage."""
    w = Window.partitionBy("id").orderBy(F.desc("rank"), "stage")
    return anchors.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


# Ranks of the stages.
SYMBOLIC, LEXICAL, SEMANTIC, GRAPH, CLAIM, DECLARED, HINT = 100, 80, 60, 60, 50, 90, 70
SEMANTIC_LIMIT, ENTRYPOINTS, CLAIMS_SCANNED = 10, 20, 10


def pipeline(given: DataFrame, hits: DataFrame, similar: DataFrame, edges: DataFrame, claims: DataFrame, max_depth: int = 2) -> DataFrame:
    """(id, source, rank) of five stages, the best rank per id.

    given: id. hits: id, bm25. similar: id, score. edges: id, src, dst (walked from the
    anchors of the first three stages, both ways, an edge further at each depth).
    claims: id (of those anchored so far).
    """
    a = given.select("id", F.lit("symbolic").alias("source"), F.lit(float(SYMBOLIC)).alias("rank"), F.lit(0).alias("stage"))
    b = hits.select("id", F.lit("lexical").alias("source"), (LEXICAL + F.least(F.abs("bm25"), F.lit(20.0))).alias("rank"), F.lit(1).alias("stage"))
    best = similar.orderBy(F.desc("score"), "id").limit(SEMANTIC_LIMIT)
    c = best.select("id", F.lit("semantic").alias("source"), (SEMANTIC + F.floor(F.col("score") * 20 + 0.5)).cast("double").alias("rank"), F.lit(2).alias("stage"))
    first = a.unionByName(b).unionByName(c)
    level = first.select(F.col("id").alias("anchor")).distinct()
    e = edges.select("id", "src", "dst")
    walk = level.join(e, (level["anchor"] == e["src"])).unionByName(level.join(e, (level["anchor"] == e["dst"]) & (e["src"] != e["dst"]))).select("anchor", "id", "src", "dst")
    out = []
    for depth in range(1, max_depth + 1):
        if depth > 1:
            prev = walk.select("anchor", F.col("id").alias("pid"), F.col("src").alias("ps"), F.col("dst").alias("pd"))
            on = prev.join(e, prev["pd"] == e["src"]).unionByName(prev.join(e, prev["ps"] == e["dst"])).filter("id <> pid")
            walk = on.select("anchor", "id", "src", "dst").distinct()
        far = F.when(F.col("dst") == F.col("anchor"), F.col("src")).otherwise(F.col("dst"))
        out.append(walk.select(far.alias("id"), F.lit("graph").alias("source"), F.lit(float(max(GRAPH - 10 * depth, 10))).alias("rank"), F.lit(3).alias("stage")))
    all_ = reduce(DataFrame.unionByName, [first, *out])
    named = claims.select("id").join(all_.select("id").distinct(), "id", "left_semi").select("id", F.lit("claim").alias("source"), F.lit(float(CLAIM)).alias("rank"), F.lit(4).alias("stage"))
    return merge_ranks(all_.unionByName(named)).drop("stage")


def entrypoints(claims: DataFrame, anchors: DataFrame, nodes: DataFrame, decorated: DataFrame, limit: int = ENTRYPOINTS) -> DataFrame:
    """(id, score, source): declared entry points, then anchored files and symbols by rank, then decorated symbols, up to the limit.

    claims: id, claim_type, path; the first CLAIMS_SCANNED by id are looked at.
    anchors: id, rank. nodes: id, kind. decorated: id.
    """
    near = claims.orderBy("id").limit(CLAIMS_SCANNED).filter((F.col("claim_type") == "likely-entrypoint") & F.col("path").isNotNull())
    known = nodes.select("id", "kind").distinct()
    a = near.select(F.concat(F.lit("node"), F.regexp_replace(F.substring("id", 6, 1 << 30), "::entrypoint$", "")).alias("id")).join(known.select("id"), "id", "left_semi")
    a = a.select("id", F.lit(float(DECLARED)).alias("score"), F.lit("claim").alias("source"), F.lit(0).alias("stage"))
    b = anchors.join(known.filter("kind in ('file', 'symbol')"), "id", "left_semi").select("id", F.col("rank").alias("score"), F.lit("anchor").alias("source"), F.lit(1).alias("stage"))
    c = decorated.select("id", F.lit(float(HINT)).alias("score"), F.lit("framework-hint").alias("source"), F.lit(2).alias("stage"))
    w = Window.partitionBy("id").orderBy("stage", F.desc("score"))
    one = a.unionByName(b).unionByName(c).withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    return one.orderBy("stage", F.desc("score"), "id").limit(limit).select("id", "score", "source")


def resolve_reference(asked: str, nodes: DataFrame, claims: DataFrame, text: DataFrame, hint: str | None = None) -> DataFrame:
    """(id, strategy, status): the first of six strategies with candidates; one is resolved, several are ambiguous (ten at most).

    nodes: id, kind. claims: id. text: object_id, object_type, text, path.
    """
    asked = asked.strip()
    hits = phrase(text, asked, "text", "path").select(F.col("object_id").alias("id"), "object_type", "text", "path") if asked else text.limit(0).select(F.col("object_id").alias("id"), "object_type", "text", "path")
    subsystems = nodes.filter("kind = 'subsystem'").select("id")
    symbol = hits.filter("object_type = 'symbol'")
    same = F.lower("text") == asked.lower()
    exact = symbol.filter(same)
    pattern = asked.replace("\\", "\\\\") + "%"
    found = [
        ("raw-id", nodes.filter(F.col("id") == asked).select("id").unionByName(claims.filter(F.col("id") == asked).select("id")), 0),
        ("path", hits.filter((F.col("object_type") == "file") & (F.col("path") == asked)).select("id"), 1),
        ("claim", claims.filter(F.col("id").ilike(pattern)).select("id"), 2),
        ("symbol", exact.select("id"), 3), ("symbol", symbol.select("id"), 4),
        ("subsystem", hits.filter(F.col("object_type").isin("node", "subsystem")).select("id").unionByName(subsystems.filter(F.col("id") == asked)).join(subsystems, "id", "left_semi"), 5),
        ("intent", hits.select("id"), 6),
    ]
    use = [df.distinct().select("id", F.lit(name).alias("strategy"), F.lit(o).alias("o")) for name, df, o in found if asked and (hint is None or hint == name)]
    if not use:
        return nodes.limit(0).select("id", F.lit("").alias("strategy"), F.lit("not_found").alias("status"))
    all_ = reduce(DataFrame.unionByName, use)
    first = all_.agg(F.min("o").alias("m"))
    best = all_.join(F.broadcast(first), F.col("o") == F.col("m")).orderBy("id").limit(10)  # first: one row
    n = best.agg(F.count("*").alias("n"))
    return best.crossJoin(F.broadcast(n)).select("id", "strategy", F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("status"))
