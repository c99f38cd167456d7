"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small: Python workers hold one batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def words(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def held_out(doc_id) -> "F.Column":
    return F.crc32(doc_id.cast("string")) % 5 == 0


# -- scratch tables ---------------------------------------------------------


class Scratch:
    """Tables written under the cluster's shared checkpoint folder.

    A written table cuts lineage and outlives lost executors. The shuffle files it was
    made from go at once; else they would stay until the driver happens to collect its
    garbage, and add up over the steps of a query. `spark.checkpoint.dir`
    names the folder; a session on one machine that has none gets a local one, on a
    cluster it is an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="checkpoints-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        cleanup = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, cleanup)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            if not hasattr(df, "_scratch_path"):  # an empty result that was never written
                continue
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


# -- hashing ----------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 300_000):
        import xxhash

        self._hash, self._seen, self._most = xxhash.xxh3_64_intdigest, {}, most

    def __call__(self, tokens: list[str]) -> np.ndarray:
        seen = self._seen
        try:
            return np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            if len(seen) > self._most:
                seen.clear()
            h = self._hash
            for w in set(tokens).difference(seen):
                seen[w] = h(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))


class TextHasher:
    """64-bit hashes of all words of a text at once, without making the words.

    A word's hash is a polynomial over random numbers that stand for its bytes,
    from differences of one running sum, then mixed; it doesn't depend on where
    the word is. Texts are taken in pieces of about PIECE bytes, cut at white space.
    """

    PIECE = 1 << 18
    BASE = 0x9E3779B97F4A7C13  # 3 mod 8, so powers of it differ in low bits

    def __init__(self, fold: bool):
        self._values = mix(np.arange(1, 257, dtype=np.uint64))
        if fold:
            self._values[65:91] = self._values[97:123]
        self._space = np.zeros(256, bool)
        self._space[[32, *range(9, 14)]] = True
        self._grow(4096)

    def _grow(self, n: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        self._up, self._down = (np.multiply.accumulate(np.array([1] + [x] * n, np.uint64)) for x in (self.BASE, inverse))

    def _piece(self, data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(data) >= len(self._up):
            self._grow(max(len(data), 2 * len(self._up)))
        edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, end = edges[::2], edges[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._values[data] * self._up[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * self._down[start] ^ (end - start).astype(np.uint64)), start, end

    def spans(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends of the words of a text in bytes."""
        data = np.frombuffer(raw, np.uint8)
        space = self._space[data]
        if len(data) <= self.PIECE:
            return self._piece(data, space)
        gaps = np.flatnonzero(space)
        cuts = gaps[np.minimum(np.searchsorted(gaps, np.arange(self.PIECE, len(data), self.PIECE)), max(len(gaps) - 1, 0))] if len(gaps) else gaps
        bounds = np.unique(np.concatenate(([0], cuts, [len(data)]))).tolist()
        parts = [(*self._piece(data[a:b], space[a:b]), a) for a, b in zip(bounds, bounds[1:], strict=False)]
        return np.concatenate([h for h, *_ in parts]), np.concatenate([s + a for _, s, _, a in parts]), np.concatenate([e + a for _, _, e, a in parts])

    def __call__(self, text: str | None) -> np.ndarray:
        return self.spans((text or "").encode("utf-8", "surrogatepass"))[0]


def rolling(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of k words: a polynomial over word hashes, then mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15 if not salt else 0xD6E8FEB86659FD93)
    if salt:
        h = mix(h ^ np.uint64(salt))
    acc = h[:n].copy()
    for i in range(1, k):
        acc *= base
        acc += h[i : i + n]
    return mix(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def arrow_list(values: np.ndarray, sizes, kind=pa.int64()) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# -- components ---------------------------------------------------------------


def components(scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected links.

    Links contract in rounds: each node takes the smallest label in its
    neighbourhood, labels jump to their own labels, and links are rewritten to
    labels and deduplicated, so a long chain halves each round at least. Nodes
    without links have no row. Nothing is collected.
    """
    spark = scratch.spark
    e = scratch.keep(
        links.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v"))
        .filter("u < v")
        .distinct()
    )
    label = None  # node -> representative so far
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = scratch.keep(low)
        if label is None and low.isEmpty():
            return spark.createDataFrame([], "node long, component long")
        # one jump: the label's own label
        jump = low.alias("x").join(low.alias("y"), F.col("x.m") == F.col("y.u"), "left").select(
            F.col("x.u").alias("u"), F.coalesce("y.m", "x.m").alias("m")
        )
        jump = scratch.keep(jump)
        if label is None:
            label = jump.select(F.col("u").alias("node"), F.col("m").alias("component"))
            stale = []
        else:
            old = label
            label = (
                old.join(jump, old["component"] == jump["u"], "left")
                .select("node", F.coalesce("m", "component").alias("component"))
            )
            stale = [old] if hasattr(old, "_scratch_path") else []
        label = scratch.keep(label)
        nxt = (
            e.join(jump.select("u", F.col("m").alias("mu")), "u")
            .join(jump.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
            .select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v"))
            .filter("u < v")
            .distinct()
        )
        nxt = scratch.keep(nxt)
        done = nxt.isEmpty()
        scratch.drop(e, low, jump, *stale)
        e = nxt
        if done:
            return label


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
