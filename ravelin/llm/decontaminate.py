"""Benchmark items in documents, also with edits.

Texts are compared as lower-case words joined by one space. An item is in a
document if some passage is within `max_edits` edits per character of it.

1. Embedding. A CGK random walk reads the text from a place on: at each of STEPS
   steps it writes the character it stands at and goes on or stays, as a random bit
   for this step and character says. Texts at a small edit distance walk alike
   and give strings at a small Hamming distance. Every character starts a walk, so
   a window of an item's size is embedded in pieces, one from each of its places:
   after an edit the pieces beyond it agree again, where one long walk would
   stay apart. Each character's bits hold as many ones as zeros, in random order.
2. Bit sampling. Of a walk's STEPS places KEPT, drawn at random, make its code.
   Each place of an item is a table of its own, repeated for WALKS independent
   walks; a window of the document falls into a table's bucket with the item if
   their codes there agree. Windows that start in the same two bands of BAND places
   are one candidate, kept if buckets of several parts of the item agree:
   FEW parts for an item below LONG characters, else MANY (and a hundredth of the
   parts of a very long one).
3. Short runs. A candidate goes on if at least SHARE of the item's runs of SHORT
   characters, one in three taken, are near where they should be.
4. Verification: the exact edit distance of the item to the best passage around
   the place, by Myers' bit-parallel algorithm.

Items below WHOLE characters have too few places; each text is compared with them
in full. Longer ones can be missed with edits close to the limit, evenly spread; the
tests and the README have the share that is found.

Items are broadcast in blocks of at most ITEMS items and CHARS characters; a
larger benchmark takes several passes. Tables grow with the characters of a
block, so an item may be long. Null and empty items or texts match nothing. Rows
that share a doc_id are one document; rows without one stay out. Repeated items
each have their row. An empty table or benchmark gives an empty table
(`drop_contaminated`: all documents). Columns of documents stay as they are, whatever
their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, union_all

STEPS, KEPT, WALKS = 20, 16, 1
PART, BAND, FEW, MANY, LONG = 8, 16, 2, 3, 120
SHORT, SHARE, WHOLE = 5, 0.2, 64
SLICE = 1_000_000  # characters that are embedded at once
ITEMS, CHARS = 5_000, 4_000_000
PAIRS = 2_000_000  # pairs of places that are counted at once
_WORDS = re.compile(r"\w+")


def normal_words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def best_edits(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any passage of the text, and where that ends."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full  # a passage may start anywhere
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def letters(text: str) -> np.ndarray:
    """One byte a character; those beyond Latin-1 are hashed."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 256, x, x * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8)


def draw(walk: int) -> tuple[np.ndarray, np.ndarray]:
    """A walk's bits by step and character, and the steps that are sampled."""
    rng = np.random.default_rng(walk + 1)
    bits = rng.permuted(np.tile((np.arange(STEPS) < STEPS // 2).astype(np.int64)[:, None], (1, 256)), axis=0)
    return bits, np.isin(np.arange(STEPS), rng.choice(STEPS, KEPT, replace=False))


_DRAWS = [draw(w) for w in range(WALKS)]


def codes(x: np.ndarray, walk: int) -> np.ndarray:
    """The sampled embedding of the text from each place on, but for the last PART - 1, as one number."""
    bits, kept = _DRAWS[walk]
    out = np.full(max(0, len(x) - PART + 1), mix(np.array([walk]))[0], np.uint64)
    padded, factor = np.concatenate([x, np.zeros(STEPS, np.uint8)]), np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(out), 8192):  # blocks that stay in the cache
        code = out[lo : lo + 8192]
        view, at = padded[lo : lo + len(code) + STEPS], np.arange(len(code))
        here, go = np.empty(len(code), np.uint8), np.empty(len(code), np.int64)
        for step in range(STEPS):
            view.take(at, out=here, mode="clip")
            if kept[step]:
                code *= factor
                code += here
            bits[step].take(here, out=go, mode="clip")
            at += go
        code ^= code >> np.uint64(29)
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)


class Items:
    """A block of items with the tables of their sampled embeddings."""

    def __init__(self, rows: list[tuple[int, str]], max_edits: float):
        self.max_edits = max_edits
        known = [(i, " ".join(words)) for i, t in rows if (words := normal_words(t))]
        self.ids, self.texts = [i for i, _ in known], [t for _, t in known]
        self.short = [k for k, t in enumerate(self.texts) if len(t) < WHOLE]
        long = [(k, w, letters(t)) for k, t in enumerate(self.texts) if len(t) >= WHOLE for w in range(WALKS)]
        made = [codes(x, w) for _, w, x in long]
        code = np.concatenate(made) if made else np.empty(0, np.uint64)
        item = np.repeat(np.array([k for k, *_ in long], np.int64), [len(g) for g in made])
        place = np.concatenate([np.arange(len(g)) for g in made]) if made else np.empty(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.known = np.zeros(1 << 22, bool)
        self.known[_slot(self.codes)] = True
        self.need = np.array([FEW if len(t) < LONG else max(MANY, len(t) // PART // 100) for t in self.texts], np.int64)
        self.longest = max(map(len, self.texts), default=0)
        self.runs: dict[int, list[tuple[int, str]]] = {}

    def places(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, from, to): places where items may start."""
        if not len(self.codes):
            return []
        gap = self.longest + 4 * BAND
        starts = np.cumsum([0, *(len(t) + gap for t in texts)])  # texts one after the other, an item apart
        whole, shift = ("\0" * STEPS).join(texts), np.cumsum([0, *(len(t) + STEPS for t in texts)])
        at, code = [], []
        for lo in range(0, max(0, len(whole) - PART + 1), SLICE):
            x = letters(whole[lo : lo + SLICE + STEPS])
            for walk in range(WALKS):
                g = codes(x, walk)[:SLICE]
                p = np.flatnonzero(self.known[_slot(g)])
                at.append(p + lo)
                code.append(g[p])
        if not at:
            return []
        at, code = np.concatenate(at), np.concatenate(code)
        row = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        same = self.codes[row] == code
        at, row = at[same], row[same]
        text = np.searchsorted(shift, at, "right") - 1
        at = at - shift[text] + starts[text]
        n = self.count[row]
        bands, parts = (int(starts[-1]) + 2 * gap) // BAND + 2, self.longest // PART + 1
        total, seen = np.cumsum(n), []
        for lo in range(0, int(total[-1]) + 1 if len(total) else 0, PAIRS):  # runs that an item repeats make many pairs
            a, b = np.searchsorted(total, [lo, lo + PAIRS], "left")
            m = n[a:b]
            which = np.repeat(self.first[row[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            item, place = self.item[which], self.place[which]
            band = item * bands + (np.repeat(at[a:b], m) - place + gap) // BAND
            seen.append(np.unique(band * parts + place // PART))
        if not seen:
            return []
        key, met = np.unique(np.unique(np.concatenate(seen)) // parts, return_counts=True)
        if not len(key):
            return []
        met = met + np.where(np.r_[np.diff(key) == 1, False], np.r_[met[1:], 0], 0)
        key = key[met >= self.need[key // bands]]
        if not len(key):
            return []
        cut = np.flatnonzero(np.diff(key) != 1) + 1
        low, high = key[np.r_[0, cut]], key[np.r_[cut - 1, len(key) - 1]]
        lo, hi = low % bands * BAND - gap, (high % bands + 2) * BAND - gap
        text = np.clip(np.searchsorted(starts, lo + gap // 2, "right") - 1, 0, len(texts) - 1)
        return list(zip(text.tolist(), (low // bands).tolist(), (lo - starts[text]).tolist(), (hi - starts[text]).tolist(), strict=True))

    def _near(self, k: int, text: str, lo: int, hi: int) -> bool:
        runs = self.runs.get(k)
        if runs is None:
            item = self.texts[k]
            runs = self.runs[k] = [(o, item[o : o + SHORT]) for o in range(0, len(item) - SHORT + 1, 3)]
        low, span = lo - BAND, hi - lo + 2 * BAND + SHORT
        text = " " * -low + text[: hi + len(self.texts[k]) + BAND] if low < 0 else text[low : hi + len(self.texts[k]) + BAND]
        need, left = SHARE * len(runs), len(runs)
        for o, run in runs:
            if run in text[o : o + span]:
                need -= 1
                if need <= 0:
                    return True
            left -= 1
            if left < need:
                return False
        return False

    def _best(self, item: str, text: str, lo: int, hi: int, limit: int) -> tuple[int, int] | None:
        """(edits, start) of the best passage of text[lo:hi], if within the limit."""
        edits, end = best_edits(item, text[lo:hi])
        if edits > limit:
            return None
        _, size = best_edits(item[::-1], text[lo : lo + end][::-1])
        return edits, lo + end - size

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """Per text (item_id, first word, edits, similarity): the best passage per item within the limit."""
        docs = [" ".join(normal_words(t)) for t in texts]
        best: list[dict[int, tuple[int, int]]] = [{} for _ in docs]
        first, size = 0, 0
        todo = []
        for d, t in enumerate(docs):
            size += len(t)
            if size >= SLICE or d == len(docs) - 1:
                todo += [(first + x, *place) for x, *place in self.places(docs[first : d + 1])]
                first, size = d + 1, 0
        todo += [(d, k, 0, len(t)) for d, t in enumerate(docs) if t for k in self.short]
        for d, k, lo, hi in todo:
            item, text = self.texts[k], docs[d]
            limit = int(self.max_edits * len(item))
            if len(item) >= WHOLE and not self._near(k, text, lo, hi):
                continue
            got = self._best(item, text, max(0, lo - BAND), hi + BAND + len(item) + limit, limit)
            if got and (k not in best[d] or got < best[d][k]):
                best[d][k] = got
        return [[(self.ids[k], text.count(" ", 0, start), edits, 1 - edits / len(self.texts[k])) for k, (edits, start) in sorted(b.items())] for text, b in zip(docs, best, strict=True)]


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str):
    """Rows (i, t) block by block: about ITEMS items and CHARS characters each."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-chars // CHARS))
    for b in range(blocks):
        yield items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i").collect()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, all columns; one pass over them per block of items."""
    spark, columns = docs.sparkSession, docs.columns
    out = docs.select("*", docs[text].alias("__text"))
    for rows in item_blocks(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast([(r.i, r.t) for r in rows])

        def run(batches, shared=shared):
            items = Items(shared.value, max_edits)
            for batch in batches:
                yield batch.filter(pa.array([not hits for hits in items.find(batch.column(batch.num_columns - 1).to_pylist())], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out.select(*columns)


def find_items(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, edits, similarity): one row for each item that a document holds."""
    spark = docs.sparkSession
    src = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names, kinds = ["doc_id", "item_id", "start_word", "edits", "similarity"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def one(rows):
        shared = spark.sparkContext.broadcast([(r.i, r.t) for r in rows])

        def run(batches):
            items = Items(shared.value, max_edits)
            for batch in batches:
                out = [(d, *hit) for d, hits in zip(batch.column(0).to_pylist(), items.find(batch.column(1).to_pylist()), strict=True) for hit in hits]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        return src.mapInArrow(run, "doc_id long, item_id long, start_word long, edits long, similarity double")

    parts = [one(rows) for rows in item_blocks(benchmark, item_id, item_text)]
    best = F.min(F.struct("edits", "start_word", "similarity"))
    found = union_all(parts).groupBy("doc_id", "item_id").agg(best.alias("x"))
    return found.select("doc_id", "item_id", "x.start_word", "x.edits", "x.similarity")
