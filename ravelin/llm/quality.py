"""Quality scores by nearest neighbours among labelled latent-semantic vectors.

A text is a bag of word shapes (letters, capitals, digits and signs, runs
collapsed), of hashed lower-case words and of immediate repetitions, all counted
over the whole text. Square roots of relative counts, weighted by inverse
document frequency, are projected on the leading singular vectors of the
labelled sample. The labelled vectors are broadcast (`sample` times `rank`
floats at most) and every document's exact cosine with each of them is computed
in blocks; its `neighbours` nearest vote with their labels, weighted by a power
of the cosine.

Only the fit uses a sample: at most `sample` labelled rows, those with the
smallest hashes of their ids. Null and empty texts have a zero vector and get
the share of label 1 in the sample. Repeated rows are scored one by one; an
empty table gives an empty table. Labels that are null are left out; without
any label the score is 0.5.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPES, WORDS = 1024, 1024
SIZE = SHAPES + WORDS + 1  # the last one counts immediate repetitions
_RUN = re.compile(r"(.)\1+", re.S)


class Features:
    """Counts of a text's shapes and words."""

    MOST = 300_000

    def __init__(self):
        self.known: dict[str, int] = {}

    def _learn(self, w: str) -> int:
        """Both features of a word in one number."""
        shape = "".join(["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c for c in w])
        shape = _RUN.sub(r"\1", shape)
        return zlib.crc32(shape.encode("utf-8", "replace")) % SHAPES * WORDS + zlib.crc32(w.lower().encode("utf-8", "replace")) % WORDS

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and square roots of relative counts."""
        words = text.split() if text else []
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        known = self.known
        try:
            both = np.array([known[w] for w in words])
        except KeyError:
            new = set(words).difference(known)
            if len(known) + len(new) > self.MOST:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self._learn(w)
            both = np.array([known[w] for w in words])
        counts = np.bincount(both // WORDS, minlength=SIZE) + np.bincount(both % WORDS + SHAPES, minlength=SIZE)
        counts[SIZE - 1] = int((both[1:] == both[:-1]).sum())
        at = np.flatnonzero(counts)
        return at.astype(np.int32), np.sqrt(counts[at] / len(words)).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, doc_id: str, text: str) -> DataFrame:
    """At most `sample` rows (id, text, y), those with the smallest hashes of their ids."""
    rows = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).cast("long").alias("__id"), F.col(label).cast("int").alias("y"))
        .groupBy("__id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(rows), "__id").select("__id", "text", "y")  # `sample` rows of two numbers


def fit(rows: DataFrame, rank: int) -> dict | None:
    """The projection, the labelled vectors and their labels; `rows` is bounded by the sample."""

    def run(batches):
        features = Features()
        for batch in batches:
            got = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("y"), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())],
                names=["id", "y", "at", "value"],
            )

    got = sorted(rows.mapInArrow(run, "id long, y int, at binary, value binary").collect())
    if not got:
        return None
    x = np.zeros((len(got), SIZE), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.at, np.int32)] = np.frombuffer(r.value, np.float32)
    idf = np.log1p(len(got) / (1 + (x > 0).sum(0))).astype(np.float32)
    x *= idf
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :rank], np.float32)
    return {"axes": idf[:, None] * axes, "vectors": unit(x @ axes), "labels": np.array([r.y for r in got], np.float32)}


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(model: dict, q: np.ndarray, neighbours: int, power: float) -> np.ndarray:
    """Scores of query vectors; the labels of the nearest weighted by their cosines."""
    y, out = model["labels"], np.empty(len(q))
    k = min(neighbours, len(y))
    for lo in range(0, len(q), 512):
        cos = q[lo : lo + 512] @ model["vectors"].T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** power
        total = w.sum(1)
        out[lo : lo + 512] = np.where(total > 0, (w * y[near]).sum(1) / np.where(total > 0, total, 1), y.mean())
    return np.clip(out, 0, 1)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", out: str = "score", keep: list[str] | None = None, sample: int = 6000, rank: int = 64, neighbours: int = 15, power: float = 8.0) -> DataFrame:
    """Adds `out`, between 0 and 1: the higher, the likelier is label 1. A column of that name is replaced."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels, label, sample, doc_id, text), rank))
    keep = [c for c in (keep if keep is not None else docs.columns) if c != out]
    src = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), f"`{out}` double"])

    def run(batches):
        features, m = Features(), model.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if m is None:
                score = np.full(len(texts), 0.5)
            else:
                q = np.zeros((len(texts), m["axes"].shape[1]), np.float32)
                for i, t in enumerate(texts):
                    at, value = features(t)
                    q[i] = value @ m["axes"][at]
                score = vote(m, unit(q), neighbours, power)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*keep, out])

    return src.mapInArrow(run, schema)
