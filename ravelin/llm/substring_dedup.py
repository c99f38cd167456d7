"""Removal of passages that occur earlier in the corpus.

A window is a run of `window` words of one document. A word goes when a window
over it holds a word sequence that also starts earlier: in a document with a
smaller id, or further up in the same one. Words are runs of bytes other than
0x20 and 0x09-0x0D, unchanged.

1. Confirmation. Of every window's runs of SEED words the one with the smallest
   hash is its seed; a count per seed, added up before the shuffle, tells which
   recur. Documents are dealt into shards of about SHARD bytes; each shard counts its
   windows with a recurring seed by two 64-bit hashes, a text with copies in it once.
   Those that occur twice in all are confirmed; the document with the smallest id that
   has them writes them down: maximal runs of windows confirmed for it, cut into
   passages of at most SEGMENT windows, with their place.
2. Automata. A passage goes to each shard that counted one of its windows, but for the
   first occurrence itself. Each shard compiles the first ANCHOR words of its passages'
   seeds into an Aho-Corasick automaton, three letters a word, and streams all of its
   documents through it, exact copies too. An anchor of many passages leads to the
   earliest that has a window here in common with the document. From each hit the
   passage is followed to both sides as far as its words agree, and compared byte by
   byte; of the stretches of `window` words or more so found in a document those go
   whose passage was written down from an earlier place.

Until the automata have run nothing is known of where in a shard passages occur but for
the document that has each window first. Nothing is collected; a passage that a third of
all documents share is one row per shard, and so are its windows.

Each step ends with a table, so that its shuffle files can go before the next one: the
texts are shuffled three times, but windows and passages never lie on disk together.

Null or empty texts have no words. Rows that share a doc_id are one document:
repeated rows get the same result each; of different texts under one id neither starts
earlier at the same position. Rows without a doc_id stay as they are. Texts shorter
than a window stay. An empty table gives an empty table. A column named like one of
the results is replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, TextHasher, arrow_list, rolling, signed

SEED = 6
ANCHOR = 4
SEGMENT = 64
CROWDED = 4  # an anchor with more entries has them by their windows
SHARD = 12 << 20
STREAM = 4 << 20  # letters of one text that pass an automaton at once
_RESULTS = ("n_words", "n_removed", "kept", "spans")


@cache
def _hasher() -> TextHasher:
    return TextHasher(fold=False)


def seed_places(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes at all positions, and each window's seed position."""
    s = rolling(h, k)
    view = np.lib.stride_tricks.sliding_window_view(s, window - k + 1)
    return s, view.argmin(1) + np.arange(len(view))


def _seeds(docs: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out, ids = [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = _hasher().spans(raw)[0]
                if len(h) >= window:
                    s, at = seed_places(h, window, k)
                    out.append(s[np.unique(at)])
                    ids.append(np.full(len(out[-1]), i, np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(out))), pa.array(np.concatenate(ids))], names=["seed", "doc_id"])

    return docs.mapInArrow(run, "seed long, doc_id long")


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of consecutive numbers: (first, last)."""
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) != 1)
    return list(zip(x[np.r_[0, cut + 1]].tolist(), x[np.r_[cut, len(x) - 1]].tolist(), strict=True))


# -- confirmation -------------------------------------------------------------------


def _confirm(window: int, k: int):
    """Shard by shard: distinct windows with a recurring seed, the smallest document that has each, and how often it occurs."""

    def run(docs: pa.Table, lists: pa.Table) -> pa.Table:
        known = dict(zip(lists.column("doc_id").to_pylist(), lists.column("seeds"), strict=True))
        texts: dict[bytes, list] = {}  # text, smallest id, copies
        for i, raw in zip(docs.column("doc_id").to_pylist(), docs.column("raw"), strict=True):
            if i in known:
                text = texts.setdefault(hashlib.sha256(raw.as_buffer()).digest(), [raw, i, 0])
                text[1:] = min(text[1], i), text[2] + 1
        parts = []
        for raw, i, copies in texts.values():
            words = _hasher().spans(raw.as_py())[0]
            if len(words) < window:
                continue
            s, at = seed_places(words, window, k)
            cand = np.flatnonzero(np.isin(s, known[i].values.to_numpy().view(np.uint64))[at])
            w, first, n = np.unique(rolling(words, window)[cand], return_index=True, return_counts=True)
            parts.append((w, rolling(words, window, 77)[cand[first]], np.full(len(w), i, np.int64), n * copies))
        a, b, c, d = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        if len(a):
            order = np.lexsort((c, b, a))
            a, b, c, d = a[order], b[order], c[order], d[order]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            a, b, c, d = a[new], b[new], c[new], np.add.reduceat(d, new)
        return pa.Table.from_arrays([pa.array(signed(a)), pa.array(signed(b)), pa.array(c), pa.array(d)], names=["w1", "w2", "doc_id", "n"])

    return run


def pack(text: bytes, at: np.ndarray) -> bytes:
    """A passage, its words joined by one space, with the numbers of its seeds' first words."""
    return struct.pack("<I", len(at)) + at.astype("<u4").tobytes() + text


def unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    n = struct.unpack_from("<I", blob)[0]
    return np.frombuffer(blob, "<u4", n, 4), blob[4 + 4 * n :]


def _passages(raw: bytes, confirmed: np.ndarray, window: int, k: int):
    """(start, packed, windows) of the passages of a text with the given windows, each where it is first."""
    h = _hasher().spans(raw)[0]
    rolled = rolling(h, window)
    w, first = np.unique(rolled, return_index=True)
    places = np.sort(first[np.isin(w, confirmed)])
    if not len(places):
        return
    _, at = seed_places(h, window, k)
    words = raw.split()
    for first, last in runs(places):
        for a in range(first, last + 1, SEGMENT):
            b = min(a + SEGMENT - 1, last)
            yield a, pack(b" ".join(words[a : b + window]), np.unique(at[a : b + 1]) - a), rolled[a : b + 1]


def passages_of(raw: bytes, confirmed: np.ndarray, window: int, k: int):
    """(start, packed) of the passages of a text."""
    for start, packed, _ in _passages(raw, confirmed, window, k):
        yield start, packed


def _write_down(window: int, k: int):
    """Shard by shard: the passages that its documents have first, and the shards they go to."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        home, w, target = (found.column(c).to_numpy() for c in ("home", "w1", "target"))
        w = w.view(np.uint64)
        order = np.lexsort((w, home))
        home, w, target = home[order], w[order], target[order]
        ids, begin = np.unique(home, return_index=True)
        known = dict(zip(ids.tolist(), zip(begin.tolist(), np.r_[begin, len(home)][1:].tolist(), strict=True), strict=True))
        homes, start, blob, shards, sizes = [], [], [], [], []
        for i, raw in zip(docs.column("doc_id").to_pylist(), docs.column("raw"), strict=True):
            if i not in known:
                continue
            own = slice(*known[i])
            for a, packed, windows in _passages(raw.as_py(), w[own], window, k):
                low, high = np.searchsorted(w[own], windows), np.searchsorted(w[own], windows, "right")
                n = high - low
                to = np.unique(target[own][np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())])
                homes.append(i)
                start.append(a)
                blob.append(packed)
                shards.append(to)
                sizes.append(len(to))
        flat = np.concatenate(shards) if shards else np.empty(0, np.int64)
        return pa.Table.from_arrays([pa.array(homes, pa.int64()), pa.array(start, pa.int32()), pa.array(blob, pa.binary()), arrow_list(flat, sizes)], names=["home", "start", "blob", "shards"])

    return run


# -- automata ---------------------------------------------------------------------------


def letters(h: np.ndarray) -> str:
    """Three letters for each word, of alphabets of their own, so that a match begins with a word."""
    x = np.empty((len(h), 3), np.uint8)
    for i in range(3):
        x[:, i] = (h >> np.uint64(46 + 6 * i)).astype(np.uint8) % 64 + 64 * i
    return x.tobytes().decode("latin-1")


class Shard:
    """Passages of a shard and the automaton of their seeds."""

    def __init__(self, passages: list[tuple[int, int, bytes]], window: int, k: int = SEED):
        import ahocorasick

        self.window, self.seed = window, 3 * k
        passages = list(dict.fromkeys(passages))
        self.home = [(home, start) for home, start, _ in passages]
        parts = [unpack(blob) for *_, blob in passages]
        self.words = [text for _, text in parts]
        hashes = _hasher().spans(b" ".join(self.words))[0]
        spelled, self.windows = letters(hashes), rolling(hashes, window)
        ends = np.cumsum([3 * (text.count(b" ") + 1) for text in self.words]).tolist()
        self.text = [spelled[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.begin = [a // 3 for a in [0, *ends]]
        size = 3 * min(ANCHOR, k)
        patterns: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, ((at, _), text) in enumerate(zip(parts, self.text, strict=True)):
            for a in (3 * at.astype(np.int64)).tolist():
                patterns[text[a : a + size]].append((n, a))
        self.size = size
        self.automaton = ahocorasick.Automaton()
        self.span = 3 * window
        for pattern, where in patterns.items():
            self.automaton.add_word(pattern, where if len(where) <= CROWDED else self._by_window(where))
        self.automaton.make_automaton()

    def _by_window(self, where: list[tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
        """Of the passages with a window over one of the seeds the one that is earliest, by the window's letters; one for each of different windows with the same letters."""
        out: dict[str, list[tuple[int, int]]] = defaultdict(list)
        seen = set()
        for n, a in sorted(where, key=lambda e: (self.home[e[0]][0], 3 * self.home[e[0]][1] + e[1])):
            text = self.text[n]
            low, high = max(0, a + self.seed - self.span), min(a, len(text) - self.span)
            for x, w in zip(range(low, high + 1, 3), self.windows[self.begin[n] + low // 3 : self.begin[n] + high // 3 + 1].tolist(), strict=True):
                if w not in seen:
                    seen.add(w)
                    out[text[x : x + self.span]].append((n, a))
        return dict(out)

    def _entries(self, text: str, at: int, where):
        """Passages of an anchor, with the seed's place, that can have a window in common with the text here."""
        if isinstance(where, list):
            return where
        over = range(max(0, at + self.seed - self.span), min(at, len(text) - self.span) + 1, 3)
        return dict.fromkeys(entry for x in over for entry in where.get(text[x : x + self.span], ()))

    def _hits(self, text: str):
        if not self.text:
            return
        for lo in range(0, len(text), STREAM):
            part = text if len(text) <= STREAM else text[lo : lo + STREAM + self.size - 1]
            for end, where in self.automaton.iter(part):
                yield lo + end - self.size + 1, where

    def mask(self, doc_id: int, raw: bytes) -> np.ndarray:
        """Which words of the document lie in a window that also starts earlier."""
        h, begin, end = _hasher().spans(raw)
        cover = np.zeros(len(h) + 1, np.int64)
        if len(h) < self.window:
            return cover[:-1] > 0
        text, found, whole, seed = letters(h), [], set(), self.seed
        for at, where in self._hits(text):
            for k, off in self._entries(text, at, where):
                if (k, at - off) in whole:
                    continue
                home, start = self.home[k]
                if home > doc_id:
                    continue
                passage = self.text[k]
                if at >= off and text.startswith(passage, at - off):
                    whole.add((k, at - off))
                    x, y = 0, len(passage) // 3
                elif text[at : at + seed] == passage[off : off + seed]:
                    x = (off - _alike(text, at, passage, off, -1) + 2) // 3
                    y = (off + seed + _alike(text, at + seed, passage, off + seed, 1)) // 3
                    if y - x < self.window:
                        continue
                else:
                    continue
                first = (at - off) // 3 + x
                if home < doc_id or start + x < first:
                    found.append((first, first + y - x, k, x, y))
        plain = None
        for a, b, k, x, y in dict.fromkeys(found):
            if plain is None:
                plain = b" ".join(raw.split())
                place = np.r_[0, np.cumsum(end - begin + 1)]
            here, there = plain[place[a] : place[b] - 1], self.words[k]
            if here == (there if y - x == len(self.text[k]) // 3 else b" ".join(there.split(b" ")[x:y])):
                cover[a] += 1
                cover[b] -= 1
            else:  # other words with the same letters: as far as the words are the same
                same = np.array([p == q for p, q in zip(here.split(b" "), there.split(b" ")[x:y], strict=True)])
                for u, v in runs(np.flatnonzero(same)):
                    if v - u + 1 >= self.window:
                        cover[a + u] += 1
                        cover[a + v + 1] -= 1
        return np.cumsum(cover[:-1]) > 0


def _alike(text: str, i: int, other: str, j: int, way: int) -> int:
    """How many letters before (way -1) or from (1) the places i and j on are the same."""
    low, high = 0, min(i, j) if way < 0 else min(len(text) - i, len(other) - j)
    while low < high:
        mid = (low + high + 1) // 2
        same = text[i - mid : i] == other[j - mid : j] if way < 0 else text[i : i + mid] == other[j : j + mid]
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with all of its fields nullable, as a result's must be."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    return pa.list_(_nullable(kind.value_type)) if pa.types.is_list(kind) else kind


def _locate(window: int, k: int):
    def run(docs: pa.Table, passages: pa.Table) -> pa.Table:
        shard = Shard(list(zip(*(passages.column(c).to_pylist() for c in ("home", "start", "blob")), strict=True)), window, k)
        n_words, n_removed, kept, starts, ends, sizes = [], [], [], [], [], []
        for i, raw in zip(docs.column("doc_id").to_pylist(), docs.column("raw"), strict=True):
            raw = raw.as_py()
            words = raw.split()
            mask = shard.mask(i, raw) if i is not None else np.zeros(len(words), bool)
            gone = runs(np.flatnonzero(mask))
            n_words.append(len(words))
            n_removed.append(int(mask.sum()))
            kept.append(b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m] if gone else words))
            starts += [a for a, _ in gone]
            ends += [b + 1 for _, b in gone]
            sizes.append(len(gone))
        pairs = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pairs)
        rest = docs.column("rest")
        out = [docs.column("doc_id"), rest.cast(_nullable(rest.type)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), spans]
        return pa.Table.from_arrays(out, names=["doc_id", "rest", *_RESULTS])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: the columns of `keep` (all but the text by default), `n_words`, `n_removed`,
    `kept` (the words that stay, joined by one space) and `spans` (removed runs of words: start, end)."""
    k = min(SEED, window)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in _RESULTS and c not in (doc_id, text)]
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("raw"), F.struct(F.lit(0).alias("__0"), *keep).alias("rest"))
    size, rows = base.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-(size + 64 * rows) // SHARD))

    def shard(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(shards)).alias("shard")

    known = base.filter("doc_id is not null").select("doc_id", "raw")
    # Tables, so that a step's shuffle files go when it is done, and so that a join
    # shuffles both sides and can split a hot key.
    scratch = Scratch(docs.sparkSession)
    seeds = scratch.keep(_seeds(known, window, k))
    recurring = scratch.keep(seeds.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"))
    lists = seeds.join(recurring, "seed").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    lists = scratch.keep(lists.select(shard(F.col("doc_id")), "doc_id", "seeds"))
    scratch.drop(seeds, recurring)

    texts = known.select(shard(F.col("doc_id")), "doc_id", "raw").groupby("shard")
    windows = texts.cogroup(lists.groupby("shard")).applyInArrow(_confirm(window, k), "w1 long, w2 long, doc_id long, n long")
    same = Window.partitionBy("w1", "w2")
    counted = windows.select("*", F.min("doc_id").over(same).alias("home"), F.sum("n").over(same).alias("times"))
    found = counted.filter("times > 1 and not (doc_id = home and n = 1)")
    found = scratch.keep(found.select(shard(F.col("home")), "home", "w1", shard(F.col("doc_id")).alias("target")))
    scratch.drop(lists)
    passages = scratch.keep(texts.cogroup(found.groupby("shard")).applyInArrow(_write_down(window, k), "home long, start int, blob binary, shards array<long>"))
    scratch.drop(found)

    at = F.when(F.col("doc_id").isNull(), F.xxhash64("raw")).otherwise(F.col("doc_id"))
    dealt = base.select(shard(at), "doc_id", "raw", "rest")
    moved = passages.select(F.explode("shards").alias("shard"), "home", "start", "blob")
    rest = dealt.schema["rest"].dataType.simpleString()
    out = dealt.groupby("shard").cogroup(moved.groupby("shard")).applyInArrow(_locate(window, k), f"doc_id long, rest {rest}, n_words long, n_removed long, kept binary, spans array<struct<start:int,`end`:int>>")
    return out.select(F.col("doc_id").alias(doc_id), *[F.col(f"rest.`{c}`").alias(c) for c in keep], "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "spans")
