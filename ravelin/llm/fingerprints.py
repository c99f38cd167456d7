"""Document fingerprints by consistent weighted sampling.

A text is a bag of words with their counts as weights. For each word and each of
SAMPLES samples two gamma(2, 1) values r, c and a uniform b follow from the
word's hash alone. With t = floor(ln(weight) / r + b) the sample takes the word
that minimises ln c - r * (t - b) - r, together with t. Two texts take the same
pair with a probability equal to their generalised Jaccard similarity, the sum
of the smaller weights over the sum of the larger; so the share of equal samples
estimates it. A fingerprint holds 16 bits of each sample as hex.

A text without words is one term if it has any characters; null and empty texts
have the fingerprint "". Equal texts have equal fingerprints. An empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mix

SAMPLES = 128
BLOCK_BITS = 12


def mixed(x: np.ndarray) -> np.ndarray:
    """`mix` in place, so that a block makes one temporary array a step."""
    t = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, np.uint64(shift), out=t)
        x ^= t
        if factor is not None:
            x *= np.uint64(factor)
    return x


class Signer:
    """Signatures of texts, made by groups of them.

    A group's words are split and numbered at once, and the values of each distinct
    one are made once, in blocks. Most words stand once in a text: what they come to
    then is kept for all of them, at most MOST; r, b and c are kept for the FULL most
    frequent, and made when they are asked for, for SPARE others at a time. Large
    arrays are made once: one that is made for a text is mapped and given back each
    time, which takes longer than to fill it.
    """

    MOST, FULL, SPARE, CHARS = 160_000, 16_384, 4_096, 6_000_000  # distinct terms and characters of a group at most
    STEP, BLOCK, PART = 8_192, 128, 512  # a block of values, and a part of a text's, stay in a core's cache

    def __init__(self, samples: int = SAMPLES):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.k = samples
        self.salts = mix(np.arange(1, 3 * samples + 1, dtype=np.uint64)).reshape(3, samples)
        self.terms, self.codes = np.zeros(self.MOST, np.uint64), np.zeros(self.MOST, np.uint64)
        self.once = np.zeros((self.MOST, samples), np.float32)
        self.slot, self.slots, self.kept = np.full(self.MOST, -1), 0, 0  # where a term's r, b and c are; how many there are, and how many stay
        self.r, self.b, self.c = (np.zeros((self.FULL + self.SPARE, samples), np.float32) for _ in range(3))
        self._first = np.zeros(self.MOST, np.intp)
        salts = self.salts.ravel()
        self._salt = np.tile(salts ^ (salts >> np.uint64(30)), (self.BLOCK, 1))
        self._x, self._t = (np.empty((self.BLOCK, 3 * samples), np.uint64) for _ in range(2))
        self._halves = np.empty((self.BLOCK, 4 * samples), np.float32)
        self._rc = np.empty((self.BLOCK, 2 * samples), np.float32)
        self._top = np.empty((self.BLOCK, samples), np.uint32)
        self._b = np.empty((self.BLOCK, samples), np.float32)
        self._a = np.empty((self.PART, samples), np.float32)
        self._least = np.empty((self.PART, samples), bool)
        self._many = [np.empty((self.PART, samples), np.float32) for _ in range(4)]

    # -- values of terms ---------------------------------------------------------

    def _values(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, b and c of a block of terms, in arrays that the next block takes."""
        k, n, half = self.k, len(terms), np.float32(0.5)
        x, t, u, rc, b, top = (v[:n] for v in (self._x, self._t, self._halves, self._rc, self._b, self._top))
        np.copyto(x, (terms ^ (terms >> np.uint64(30)))[:, None])  # the first step of `mix` may be taken before the salts come in
        x ^= self._salt[:n]
        for shift, factor in ((27, 0xBF58476D1CE4E5B9), (31, 0x94D049BB133111EB)):
            x *= np.uint64(factor)
            np.right_shift(x, np.uint64(shift), out=t)
            x ^= t
        parts = x.view("<u4")
        np.copyto(u, parts[:, : 4 * k], casting="unsafe")
        u += half
        np.multiply(u[:, 1::2], u[:, ::2], out=rc)  # a product of two uniform numbers from the halves of x
        rc *= np.float32(2.0**-64)
        np.minimum(rc, np.float32(1 - 2**-20), out=rc)
        np.log(rc, out=rc)
        np.negative(rc, out=rc)
        r, c = rc[:, :k], rc[:, k:]
        np.log(c, out=c)
        np.right_shift(parts[:, 4 * k + 1 :: 2], np.uint32(8), out=top)
        np.copyto(b, top, casting="unsafe")
        b *= np.float32(2.0**-24)
        return r, b, c

    def _full(self, rows: np.ndarray, r: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        lo, self.slots = self.slots, self.slots + len(rows)
        self.slot[rows] = np.arange(lo, self.slots)
        self.r[lo : self.slots], self.b[lo : self.slots], self.c[lo : self.slots] = r, b, c

    def _learn(self, words: list[bytes], counts: np.ndarray) -> None:
        """The values of these terms, instead of any others."""
        n = len(words)
        often = np.ones(n, bool)
        if n > self.FULL:
            often[np.argpartition(counts, n - self.FULL)[: n - self.FULL]] = False
        h = self.terms[:n]
        h[:] = np.fromiter(map(self.hash, words), np.uint64, n)
        self.codes[:n] = mixed(h ^ mix(np.ones(1, np.uint64)))
        self.slot[:n], self.slots = -1, 0
        for i in range(0, n, self.BLOCK):
            r, b, c = self._values(h[i : i + self.BLOCK])
            once = self.once[i : i + len(r)]
            np.subtract(np.float32(1), b, out=once)  # c - r * (1 - b)
            once *= r
            np.subtract(c, once, out=once)
            at = np.flatnonzero(often[i : i + len(r)])
            self._full(i + at, r[at], b[at], c[at])
        self.kept = self.slots

    def _slots(self, rows: np.ndarray) -> np.ndarray:
        """Where r, b and c of these terms are; PART terms at most."""
        new = rows[self.slot[rows] < 0]
        if self.slots + len(new) > len(self.r):
            self.slot[self.slot >= self.kept] = -1
            self.slots = self.kept
            new = rows[self.slot[rows] < 0]
        for i in range(0, len(new), self.BLOCK):
            part = new[i : i + self.BLOCK]
            self._full(part, *self._values(self.terms[part]))
        return self.slot[rows]

    # -- signatures ----------------------------------------------------------------

    def __call__(self, text: str | None) -> bytes:
        """SAMPLES little-endian 16-bit numbers; nothing for an empty text."""
        return self.sign([text])[0]

    def sign(self, texts: list[str | None]) -> list[bytes]:
        """The signatures of texts, in their order."""
        out, lo, chars = [], 0, 0
        for i, t in enumerate(texts):
            chars += len(t or "")
            if chars > self.CHARS and i > lo:
                out += self._group(texts[lo:i])
                lo, chars = i, len(t or "")
        return out + self._group(texts[lo:]) if lo < len(texts) else out

    def _group(self, texts: list[str | None]) -> list[bytes]:
        words = None
        if len(texts) > 1 or len(texts[0] or "") <= self.CHARS:
            try:
                split = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], pa.string()))  # as str.split, but with empty words at white space on the ends
                words = split.flatten().dictionary_encode()
            except UnicodeEncodeError:  # half a surrogate pair
                pass
        if words is None or len(words.dictionary) > self.MOST:
            half = len(texts) // 2
            return self._group(texts[:half]) + self._group(texts[half:]) if half else [self._long(texts[0])]
        rows = words.indices.to_numpy()
        self._learn(words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), np.bincount(rows))
        ends, empty = split.offsets.to_numpy(), words.dictionary.index("").as_py()  # -1 for none
        out, bare = [], []
        for i, (t, lo, hi) in enumerate(zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            at = rows[lo:hi]
            if at[0] == empty or at[-1] == empty:
                at = at[at != empty]
            out.append(self._signed(at) if len(at) else b"")
            if t and not len(at):
                bare.append(i)
        for i in bare:  # they are terms themselves
            out[i] = self._long(texts[i])
        return out

    def _long(self, text: str | None) -> bytes:
        """The signature of one text, by STEP terms at a time."""
        if not text:
            return b""
        bag = Counter(text.split() or [text])
        terms, counts = [w.encode("utf-8", "surrogatepass") for w in bag], np.fromiter(bag.values(), np.int64, len(bag))
        best, code = self._none()
        for lo in range(0, len(terms), self.STEP):
            part, count = terms[lo : lo + self.STEP], counts[lo : lo + self.STEP]
            self._learn(part, count)
            self._lower(np.arange(len(part)), count, best, code)
        return code.astype("<u2").tobytes()

    def _none(self) -> tuple[np.ndarray, np.ndarray]:
        return np.full(self.k, np.inf, np.float32), np.zeros(self.k, np.uint64)

    def _signed(self, words: np.ndarray) -> bytes:
        """The signature of words by their rows."""
        place = np.arange(len(words))
        self._first[words[::-1]] = place[::-1]  # of repeated words the first place stays
        first = self._first[words]
        heads = np.flatnonzero(first == place)
        best, code = self._none()
        self._lower(words[heads], np.bincount(first)[heads], best, code)
        return code.astype("<u2").tobytes()

    def _lower(self, rows: np.ndarray, counts: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
        """Lowers `best` by terms and their counts, and gives the samples they win their codes."""
        k = self.k
        for i in range(0, len(rows), self.PART):
            at, count = rows[i : i + self.PART], counts[i : i + self.PART]
            a = np.take(self.once, at, 0, out=self._a[: len(at)], mode="clip")
            many = np.flatnonzero(count > 1)
            if len(many):
                r, b, c, t = (v[: len(many)] for v in self._many)
                slots = self._slots(at[many])
                for values, out in ((self.r, r), (self.b, b), (self.c, c)):
                    np.take(values, slots, 0, out=out, mode="clip")
                np.divide(np.log(count[many].astype(np.float32))[:, None], r, out=t)
                t += b
                np.floor(t, out=t)
                np.subtract(t, b, out=b)  # c - r * (t - b) - r
                b *= r
                c -= b
                c -= r
                a[many] = c
            low = a.min(0)
            flat = np.flatnonzero(np.equal(a, low, out=self._least[: len(at)]))[::-1]
            win = np.empty(k, np.intp)
            win[flat % k] = flat // k  # of equals the first one stays
            mark = self.codes[at[win]]
            if len(many):
                of = np.full(len(at), -1)
                of[many] = np.arange(len(many))
                of = of[win]
                cols = np.flatnonzero(of >= 0)
                level = t[of[cols], cols].astype(np.int64).astype(np.uint64)
                mark[cols] = mixed(self.terms[at[win[cols]]] ^ mixed(level + np.uint64(1)))
            better = low < best
            np.copyto(best, low, where=better)
            np.copyto(code, mark, where=better)


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal samples; 1 for two empty texts, 0 for an empty and another one."""
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """Adds `out`. Repeated rows get one each; a column of that name is replaced."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != out]
    src = df.select(*keep, df[text].alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), f"`{out}` string"])

    def run(batches):
        sign = Signer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.hex() for x in sign.sign(batch.column(batch.num_columns - 1).to_pylist())], pa.string())], names=[*keep, out])

    return src.mapInArrow(run, schema)


# -- each document against an edited copy and the next document ----------------------

_ROW = "sid long, block long, kind int, doc_id long, n_chars long, edited_sha256 string, fp binary, edited binary, near_edited double, near_next double, z binary"


def _packed(docs: DataFrame) -> DataFrame:
    """Texts packed before they are moved."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["doc_id", "z"])

    return docs.mapInArrow(run, "doc_id long, z binary")


def edit(text: str, nxt: str) -> str:
    """The last third of the code points replaced by as many of the next text's first."""
    k = len(text) // 3
    return text[: len(text) - k] + nxt[:k]


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: fingerprints of the text and of its edited copy, and their likenesses.

    "Next" goes by descending doc_id, after the last comes the first. Documents
    are dealt by blocks of ids and streamed in order, so the next text is the next
    row; only a block's last row and first row meet in a second, small step. Rows
    that share a doc_id stand side by side in the order of their packed texts; rows
    without one stand last, in an order that their texts' hashes give.
    """
    scratch = Scratch(docs.sparkSession)
    low = -(1 << 62)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = (
        _packed(src)
        .withColumn("sid", F.coalesce("doc_id", low - F.pmod(F.xxhash64("z"), F.lit(1 << 30))))
        .withColumn("block", F.shiftright("sid", BLOCK_BITS))
        .repartition("block")
        .sortWithinPartitions("block", F.desc("sid"), "z")
        .select("doc_id", "z", "sid", "block")
    )
    names = [c.split(" ")[0] for c in _ROW.split(", ")]

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        sign = Signer()
        held = None  # (sid, block, doc_id, text, fp, z) that waits for its next
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.binary()]

        def last(h):  # a block's last row goes out unfinished, with its text
            return (h[0], h[1], 2, h[2], len(h[3]), None, h[4], None, None, None, h[5])

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def pairs(rows):
            nonlocal held
            before, texts = held and held[:2] + held[3:4], []
            for sid, block, _, t, _ in rows:  # each text after the edited copy that ends with it
                texts += [edit(before[2], t) if before and before[1] == block else None, t]
                before = (sid, block, t)
            out, signs = [], iter(sign.sign(texts))
            for (sid, block, doc, t, z), e in zip(rows, texts[::2], strict=True):
                efp, fp = next(signs), next(signs)
                if e is None:
                    if held is not None:
                        out.append(last(held))
                    out.append((sid, block, 1, doc, None, None, fp, None, None, None, z))  # a block's first row, for the block above
                else:
                    out.append((held[0], block, 0, held[2], len(held[3]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), held[4], efp, likeness(held[4], efp), likeness(held[4], fp), None))
                held = (sid, block, doc, t, fp, z)
            return emit(out)

        rows, chars = [], 0
        for batch in batches:
            for doc, z, sid, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = unpack(z).decode("utf-8", "surrogatepass")
                rows.append((sid, block, doc, t, z))
                chars += 2 * len(t)  # with its edited copy
                if chars >= sign.CHARS or len(rows) >= 4096:
                    yield pairs(rows)
                    rows, chars = [], 0
        if rows:
            yield pairs(rows)
        if held is not None:
            yield emit([last(held)])

    made = scratch.keep(ordered.mapInArrow(run, _ROW))

    heads = made.filter("kind = 1").select("block", "fp", "z")
    group = F.shiftright("block", BLOCK_BITS)
    blocks = heads.select("block", group.alias("g"))
    tops = blocks.groupBy("g").agg(F.max("block").alias("top"))
    order = tops.withColumn("below", F.lead("top").over(Window.orderBy(F.desc("g")))).crossJoin(tops.agg(F.max("top").alias("first")))  # one row
    chain = (
        blocks.withColumn("nxt", F.lead("block").over(Window.partitionBy("g").orderBy(F.desc("block"))))
        .join(order, "g")
        .select("block", F.coalesce("nxt", "below", "first").alias("next_block"))
    )
    ends = (
        made.filter("kind = 2").select("block", "doc_id", "n_chars", "fp", "z")
        .join(chain, "block")
        .join(heads.select(F.col("block").alias("next_block"), F.col("z").alias("z2"), F.col("fp").alias("fp2")), "next_block")
        .select("doc_id", "n_chars", "fp", "z", "z2", "fp2")
    )

    def finish(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        sign = Signer()
        for batch in batches:
            fps, zs, z2s, fp2s = (batch.column(c).to_pylist() for c in ("fp", "z", "z2", "fp2"))
            efps, shas, es, chars = [], [], [], 0
            for pair in zip(zs, z2s, strict=True):
                es.append(edit(*(unpack(x).decode("utf-8", "surrogatepass") for x in pair)))
                shas.append(hashlib.sha256(es[-1].encode("utf-8", "surrogatepass")).hexdigest())
                chars += len(es[-1])
                if chars >= sign.CHARS:
                    efps += sign.sign(es)
                    es, chars = [], 0
            efps += sign.sign(es)
            ne, nn = [*map(likeness, fps, efps)], [*map(likeness, fps, fp2s)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), pa.array(shas, pa.string()), batch.column("fp"), pa.array(efps, pa.binary()), pa.array(ne, pa.float64()), pa.array(nn, pa.float64())], names=["doc_id", "n_chars", "edited_sha256", "fp", "edited", "near_edited", "near_next"])

    rest = ends.mapInArrow(finish, "doc_id long, n_chars long, edited_sha256 string, fp binary, edited binary, near_edited double, near_next double")
    cols = ["doc_id", "n_chars", "edited_sha256", "fp", "edited", "near_edited", "near_next"]
    hexed = lambda c: F.lower(F.hex(c))
    return (
        made.filter("kind = 0").select(*cols).unionByName(rest)
        .select(F.col("doc_id").alias(doc_id), "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited").alias("edited_fingerprint"), "near_edited", "near_next")
    )
