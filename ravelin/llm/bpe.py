"""Byte-level BPE by a segment tree over adjacent pair ranks.

A leaf holds the rank of the pair that starts there, joined with its position;
an inner node holds the smaller of its children. The root is therefore the
leftmost pair of lowest rank. A merge changes three leaves at most, each in
logarithmic time, until no leaf holds a mergeable pair.

Two forms of the same tree: `SegmentTree` for one long pre-token and
`encode_many`, which keeps one row of a matrix per pre-token and does one merge
in every row at each step.

Null texts count as empty; empty texts have no ids.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_list

# Fixed values of the published byte-level pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Character ranges where the pattern library and the tokenizer library hold the same classes.
_PLAIN = re.compile("[\x00-ԯ‐-⁞]*")
_UNSTABLE = re.compile(r"\s | \s|^ | $")
_STABLE_CUT = re.compile(r"(?<=\S) (?=\S)")


def stable_pieces(text: str) -> list[str]:
    """Cut where a lone space stands between two other characters.

    There the pattern always ends one pre-token and starts another, whatever
    stands further away, so the pieces encode independently. All pieces but the
    first lack the space they start with.
    """
    if not _UNSTABLE.search(text):
        return text.split(" ")
    return _STABLE_CUT.split(text)


def _byte_letters() -> list[str]:
    """The printable letter for each byte: printable Latin-1 itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Vocabulary:
    """Ids, pair ranks and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = _byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 20 | right
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        self.rank = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * top
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """Ranks of pairs; `none` where a pair doesn't merge."""
        keys = left << 20 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], none)


class SegmentTree:
    """One sequence of ids, merged to the end."""

    def __init__(self, vocab: Vocabulary, ids: list[int]):
        self.v, self.ids, n = vocab, ids, len(ids)
        self.size = 1 << max(1, (n - 1).bit_length())
        self.none = (1 << 62, 0)
        self.next = [*range(1, n), -1]
        self.prev = [*range(-1, n - 1)]
        self.tree = [self.none] * (2 * self.size)
        for i in range(n - 1):
            self.tree[self.size + i] = self._leaf(i)
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def _leaf(self, i: int) -> tuple[int, int]:
        j = self.next[i]
        r = self.v.rank.get(self.ids[i] << 20 | self.ids[j]) if j >= 0 else None
        return self.none if r is None else (r, i)

    def _put(self, i: int, value: tuple[int, int]) -> None:
        k, tree = self.size + i, self.tree
        tree[k] = value
        k >>= 1
        while k:
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
            k >>= 1

    def run(self) -> list[int]:
        while self.tree[1] != self.none:
            r, i = self.tree[1]
            j = self.next[i]
            self.ids[i] = int(self.v.merged[r])
            self.next[i] = k = self.next[j]
            if k >= 0:
                self.prev[k] = i
            self._put(j, self.none)
            self._put(i, self._leaf(i))
            if (p := self.prev[i]) >= 0:
                self._put(p, self._leaf(p))
        out, i = [], 0
        while i >= 0:
            out.append(self.ids[i])
            i = self.next[i]
        return out


def _encode_rows(v: Vocabulary, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, and how many each has."""
    n, none = len(rows), 1 << 50
    size = np.array([len(r) for r in rows])
    inside = np.arange(width) < size[:, None]
    ids = np.zeros((n, width + 1), np.int64)
    ids[:, :width][inside] = v.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
    nxt = np.tile(np.arange(1, width + 2), (n, 1))
    nxt[np.arange(n), size - 1] = width  # `width` means no neighbour
    prv = np.tile(np.arange(-1, width), (n, 1))
    prv[:, 0] = width
    tree = np.full((n, 2 * width), none, np.int64)
    pair = np.arange(width) < size[:, None] - 1
    r, c = np.nonzero(pair)
    got = v.ranks(ids[r, c], ids[r, c + 1], -1)
    ok = got >= 0
    tree[r[ok], width + c[ok]] = got[ok] * width + c[ok]
    for k in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    alive = inside.copy()
    rows_on = np.nonzero(tree[:, 1] < none)[0]
    while len(rows_on):
        w = rows_on
        root = tree[w, 1]
        i, rank = root % width, root // width
        j = nxt[w, i]
        ids[w, i] = v.merged[rank]
        alive[w, j] = False
        k = nxt[w, j]
        nxt[w, i] = k
        prv[w, k] = i  # column `width` takes what has no neighbour
        p = prv[w, i]
        has_k, has_p = k < width, p < width
        left = np.concatenate([ids[w, i], ids[w, p]])
        right = np.concatenate([ids[w, k], ids[w, i]])
        got = v.ranks(left, right, -1)
        at = np.concatenate([i, p])
        fits = (got >= 0) & np.concatenate([has_k, has_p])
        value = np.where(fits, got * width + at, none)
        ww = np.concatenate([w, w[has_p], w])
        leaf = np.concatenate([i, p[has_p], j])
        tree[ww, width + leaf] = np.concatenate([value[: len(w)], value[len(w) :][has_p], np.full(len(w), none)])
        node = (width + leaf) >> 1
        for _ in range(width.bit_length() - 1):
            tree[ww, node] = np.minimum(tree[ww, 2 * node], tree[ww, 2 * node + 1])
            node >>= 1
        rows_on = w[tree[w, 1] < none]
    return ids[:, :width][alive], alive.sum(1)


def encode_many(v: Vocabulary, tokens: list[bytes]) -> list[bytes]:
    """Ids of each pre-token as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(tokens)
    by_width: dict[int, list[int]] = {}
    for k, t in enumerate(tokens):
        if len(t) > 64:
            out[k] = np.array(SegmentTree(v, v.byte_id[np.frombuffer(t, np.uint8)].tolist()).run(), "<u4").tobytes()
        elif t:
            by_width.setdefault(1 << max(1, (len(t) - 1).bit_length()), []).append(k)
    for width, places in by_width.items():
        for lo in range(0, len(places), 8192):
            part = places[lo : lo + 8192]
            ids, sizes = _encode_rows(v, [tokens[k] for k in part], width)
            raw, at = ids.astype("<u4").tobytes(), 0
            for k, s in zip(part, (sizes * 4).tolist(), strict=True):
                out[k] = raw[at : at + s]
                at += s
    return out


class Codec:
    """Encodes and decodes texts; remembers pieces and pre-tokens up to a bound."""

    MOST = 400_000

    def __init__(self, path: str):
        import regex

        self.path, self.v = path, Vocabulary(path)
        self.find = regex.compile(PATTERN).findall
        self.pieces: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self._library = None

    def _pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if _PLAIN.fullmatch(text):
            return self.find(text)
        if self._library is None:  # newer letters: classes as the tokenizer library has them
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _parts(self, text: str) -> list[str]:
        """Pre-tokens and special strings in order."""
        if self.v.split_special is None or not any(s in text for s in self.v.special):
            return self._pretokens(text)
        out: list[str] = []
        for k, part in enumerate(self.v.split_special.split(text)):
            out += [part] if k % 2 else self._pretokens(part) if part else []
        return out

    def _learn(self, texts: list[str]) -> list[bytes]:
        special = self.v.special
        blob = "\0".join(texts)
        if _PLAIN.fullmatch(blob) and not any(s in blob for s in special):
            parts = [*map(self.find, texts)]
        else:
            parts = [self._parts(t) for t in texts]
        used = {p for ps in parts for p in ps}
        new = [*used.difference(self.tokens)]
        if len(self.tokens) + len(new) > self.MOST:  # what is in use now stays
            self.tokens = {p: self.tokens[p] for p in used.intersection(self.tokens)}
        for p, ids in zip(new, encode_many(self.v, [b"" if p in special else p.encode() for p in new]), strict=True):
            self.tokens[p] = ids or np.array([special[p]], "<u4").tobytes()
        got = self.tokens
        return [b"".join([got[p] for p in ps]) for ps in parts]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        cut = [stable_pieces(t) if t else [] for t in texts]
        rest = {p for ps in cut for p in ps[1:]}
        new = [*rest.difference(self.pieces)]
        if len(self.pieces) + len(new) > self.MOST:
            self.pieces = {p: self.pieces[p] for p in rest.intersection(self.pieces)}
        for lo in range(0, len(new), 50_000):
            part = new[lo : lo + 50_000]
            self.pieces.update(zip(part, self._learn([" " + p for p in part]), strict=True))
        first = iter(self._learn([ps[0] for ps in cut if ps]))
        got = self.pieces
        return [b"".join([next(first), *[got[p] for p in ps[1:]]]) if ps else b"" for ps in cut]

    def decode(self, ids: bytes) -> str:
        of = self.v.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: str = "ids", decoded: str | None = "decoded", as_list: bool = False) -> DataFrame:
    """Adds `ids` (binary: little-endian unsigned 32-bit ids, or with `as_list` an array of int) and `decoded`, the text they give.

    `keep` names the columns that stay (all by default). A column of the frame
    with the name of a new one is replaced. Null texts count as empty, repeated
    rows are encoded one by one, an empty table gives an empty table. The
    tokenizer file must lie at `path` on every executor.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c not in (ids, decoded)]
    src = df.select(*keep, df[text].alias("__text"))
    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep), f"`{ids}` {'array<int>' if as_list else 'binary'}", *([f"`{decoded}` string"] if decoded else [])])

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            got = codec.encode_batch(batch.column(batch.num_columns - 1).to_pylist())
            packed = arrow_list(np.frombuffer(b"".join(got), "<u4").astype(np.int32), [len(x) // 4 for x in got], pa.int32()) if as_list else pa.array(got, pa.binary())
            cols = [*batch.columns[:-1], packed]
            if decoded:
                cols.append(pa.array([codec.decode(x) for x in got], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, ids, *([decoded] if decoded else [])])

    return src.mapInArrow(run, schema)
