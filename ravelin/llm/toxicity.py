"""Toxicity scores by a counterfactual-regularised linear classifier.

Features say which normalised words, and which beginnings of words, a whole text
holds. Logistic regression is fitted to labelled texts; besides, in every
labelled sentence that names a group of people each such term is swapped for
another of its kind, and the squared change of the sentence's score is
penalised. So the naming itself carries no weight, and neutral mentions stay
below the threshold.

Only the fit uses a sample: at most `sample` labelled rows, those with the
smallest hashes of their ids. Null and empty texts have no features and get the
score of the intercept. Repeated rows are scored one by one; an empty table
gives an empty table. Without labels the score is 0.5.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .quality import labelled_sample

# Terms for groups of people, by kind and language.
IDENTITY_TERMS = {
    "religion_en": "muslims christians jews hindus buddhists atheists catholics sikhs",
    "religion_one_en": "muslim christian jewish hindu buddhist atheist catholic sikh",
    "origin_en": "africans asians europeans americans arabs mexicans immigrants refugees",
    "origin_one_en": "african asian european american arab mexican immigrant refugee",
    "sexuality_en": "gay lesbian bisexual heterosexual straight queer transgender",
    "gender_en": "women men girls boys",
    "gender_one_en": "woman man girl boy",
    "ability_en": "deaf blind disabled autistic",
    "religion_de": "muslime christen juden hindus buddhisten atheisten katholiken",
    "gender_de": "frauen männer mädchen jungen",
    "origin_de": "afrikaner asiaten europäer amerikaner araber ausländer flüchtlinge",
    "religion_fr": "musulmans chrétiens juifs hindous bouddhistes athées catholiques",
    "gender_fr": "femmes hommes filles garçons",
    "origin_fr": "africains asiatiques européens américains arabes immigrés réfugiés",
    "religion_es": "musulmanes cristianos judíos hindúes budistas ateos católicos",
    "gender_es": "mujeres hombres chicas chicos",
    "origin_es": "africanos asiáticos europeos americanos árabes inmigrantes refugiados",
}
_PEERS = {t: ts for line in IDENTITY_TERMS.values() for ts in [line.split()] for t in ts}
_SENTENCE = re.compile(r"[.!?\n]+")
HASHED = 1 << 18
BEGINNINGS = range(3, 8)


def normal(word: str) -> str:
    """Lower case, without signs at either end."""
    w = word.lower()
    if w.isalpha():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalpha():
        a += 1
    while b > a and not w[b - 1].isalpha():
        b -= 1
    return w[a:b]


def word_features(word: str) -> list[int]:
    """Places of a normalised word and its beginnings."""
    if not word:
        return []
    raw = word.encode("utf-8", "replace")
    return [zlib.crc32(b"=" + raw) % HASHED, *(zlib.crc32(b"^" + word[:n].encode("utf-8", "replace")) % HASHED for n in BEGINNINGS if n <= len(word))]


def text_features(text: str | None) -> np.ndarray:
    words = {normal(w) for w in text.split()} if text else ()
    return np.unique(np.array([f for w in words for f in word_features(w)], np.int32))


def swaps(text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of each sentence that names a group, as it is and with each such term swapped."""
    out = []
    for sentence in _SENTENCE.split(text or ""):
        words = [normal(w) for w in sentence.split()]
        if any(w in _PEERS for w in words):
            other = [_PEERS[w][(_PEERS[w].index(w) + 1 + zlib.crc32(sentence.encode("utf-8", "replace")) % (len(_PEERS[w]) - 1)) % len(_PEERS[w])] if w in _PEERS else w for w in words]
            out.append((text_features(" ".join(words)), text_features(" ".join(other))))
    return out


class Rows:
    """Sparse rows of ones (or signed ones): products with weights both ways."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None, width: int):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.value = np.concatenate(values) if values else np.ones(len(self.at))
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.width = width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], len(self.sizes))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], self.width)


def train(features: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], most: int = 20_000, least: int = 4, strength: float = 4.0, ridge: float = 3e-5, rounds: int = 800, positive: float = 4.0) -> tuple[dict[int, float], float]:
    """Weights by place and the intercept."""
    n, pos = len(y), y.sum()
    df = np.zeros(HASHED)
    hit = np.zeros(HASHED)
    for f, t in zip(features, y, strict=True):
        df[f] += 1
        hit[f] += t
    share = pos / n
    z = (hit - df * share) / np.sqrt(np.maximum(df * share * (1 - share), 1e-9))
    good = (df >= least) & (np.abs(z) >= 3.0)
    named = np.unique(np.concatenate([np.setxor1d(a, b) for a, b in pairs])) if pairs else np.empty(0, np.int64)
    chosen = np.flatnonzero(good)
    chosen = chosen[np.argsort(-np.abs(z[chosen]), kind="stable")][:most]
    chosen = np.union1d(chosen, named[df[named] >= least]) if len(named) else np.sort(chosen)
    place = np.full(HASHED, -1)
    place[chosen] = np.arange(len(chosen))
    cut = lambda f: (p := place[f])[p >= 0]
    x = Rows([cut(f) for f in features], None, len(chosen))
    gone = [(cut(np.setdiff1d(a, b)), cut(np.setdiff1d(b, a))) for a, b in pairs]
    d = Rows([np.concatenate(g) for g in gone], [np.r_[np.ones(len(g[0])), -np.ones(len(g[1]))] for g in gone] or None, len(chosen))
    w, b = np.zeros(len(chosen)), np.log((pos + 1) / (n - pos + 1))
    weight = np.where(y > 0, positive, 1.0)  # texts with one hint only are rare among label 1
    m, v, step = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0.05
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -40, 40)))
        r = (p - y) * weight / n
        g = x.back(r) + ridge * w
        if len(gone):
            g += 2 * strength / len(gone) * d.back(d.dot(w))
        full = np.r_[g, r.sum()]
        m = 0.9 * m + 0.1 * full
        v = 0.999 * v + 0.001 * full**2
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return {int(f): float(u) for f, u in zip(chosen, w, strict=True) if abs(u) > 1e-6}, float(b)


def fit(rows: DataFrame, **options) -> tuple[dict[int, float], float]:
    """`rows` is bounded by the sample; what is collected of them are their features."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pairs = [swaps(t) for t in texts]
            pack = lambda p: b"".join(len(x).to_bytes(4, "little") + x.astype("<i4").tobytes() for two in p for x in two)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("y"), pa.array([text_features(t).tobytes() for t in texts], pa.binary()), pa.array([pack(p) for p in pairs], pa.binary())], names=["id", "y", "at", "pairs"])

    got = sorted(rows.mapInArrow(run, "id long, y int, at binary, pairs binary").collect())
    if not got:
        return {}, 0.0
    pairs = []
    for r in got:
        at, both = 0, []
        while at < len(r.pairs):
            size = int.from_bytes(r.pairs[at : at + 4], "little")
            both.append(np.frombuffer(r.pairs, "<i4", size, at + 4))
            at += 4 + 4 * size
        pairs += list(zip(both[::2], both[1::2], strict=True))
    return train([np.frombuffer(r.at, np.int32) for r in got], np.array([float(r.y) for r in got]), pairs, **options)


class Scorer:
    MOST = 400_000

    def __init__(self, weights: dict[int, float], intercept: float):
        self.w, self.b, self.known = weights, intercept, {}

    def __call__(self, text: str | None) -> float:
        """A feature counts once a text, however many words have it."""
        words = set(text.split()) if text else set()
        known = self.known
        new = words.difference(known)
        if new:
            if len(known) + len(new) > self.MOST:
                known.clear()
                new = words
            has = self.w
            for x in new:
                known[x] = [f for f in word_features(normal(x)) if f in has] or None
        seen = {f for x in words if (fs := known[x]) for f in fs}
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, self.b + sum(self.w[f] for f in sorted(seen)))))))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", out: str = "score", keep: list[str] | None = None, sample: int = 12_000, **options) -> DataFrame:
    """Adds `out`, between 0 and 1: the higher, the likelier is label 1. A column of that name is replaced."""
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, label, sample, doc_id, text), **options))
    keep = [c for c in (keep if keep is not None else docs.columns) if c != out]
    src = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), f"`{out}` double"])

    def run(batches):
        scorer = Scorer(*model.value)
        for batch in batches:
            got = [scorer(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], names=[*keep, out])

    return src.mapInArrow(run, schema)
