"""Token counts of whole texts, as the tokenizer's own library gives them.

Huge documents are encoded as overlapping chunks with offsets. Two chunks are
spliced where both start a token at the same place and that place is a proven
stable boundary: a lone space between two other characters, where byte-level
pre-tokenisation always ends one pre-token and starts the next, whatever stands
further away. Where an overlap has no such place it is widened, at worst to the
whole document. Other documents are cut at the same boundaries and the counts
of their pieces remembered, up to a bound.

Null texts count as empty (0 bytes, 0 tokens); repeated rows are counted one by
one; an empty table gives an empty table.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _STABLE_CUT, stable_pieces


def starts(encoding) -> list[int]:
    return [a for a, _ in encoding.offsets]


def spliced_count(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of `text` from chunks of `chunk` characters that share `overlap`."""
    total, lo, n = 0, 0, len(text)
    floor = 0  # tokens that start before this place are counted already
    hi = min(n, chunk)
    now = starts(tokenizer.encode(text[lo:hi], add_special_tokens=False))
    while hi < n:
        wide = overlap
        while True:
            nlo, nhi = max(lo, hi - wide), min(n, hi + chunk - overlap)
            nxt = starts(tokenizer.encode(text[nlo:nhi], add_special_tokens=False))
            both = {a + lo for a in now}.intersection(a + nlo for a in nxt)
            cuts = [p for m in _STABLE_CUT.finditer(text, nlo, hi) if (p := m.start()) in both and p > max(floor, nlo)]
            if cuts or (nlo == lo and nhi == n):
                break
            # widen: further back, and when that is spent, a longer first chunk
            if nlo > lo:
                wide *= 2
            else:
                hi = min(n, hi + chunk)
                now = starts(tokenizer.encode(text[lo:hi], add_special_tokens=False))
                if hi == n:
                    break
        if hi == n:
            break
        if not cuts:  # no stable place at all up to the end
            hi = n
            now = starts(tokenizer.encode(text[lo:hi], add_special_tokens=False))
            break
        cut = cuts[-1]
        total += sum(floor <= a + lo < cut for a in now)
        floor, lo, hi, now = cut, nlo, nhi, nxt
    return total + sum(a + lo >= floor for a in now)


class Counter:
    MOST = 600_000

    def __init__(self, path: str, huge: int, chunk: int, overlap: int):
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.local, self.count = False, lambda texts: [len(x) for x in lib.encode(texts)]
            return
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.local = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.count = lambda texts: [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.local:
            return self.count(texts)
        out = [spliced_count(self.tokenizer, t, self.chunk, self.overlap) if len(t) > self.huge else -1 for t in texts]
        cut = [stable_pieces(t) if n < 0 and t else [] for t, n in zip(texts, out, strict=True)]
        used = {p for ps in cut for p in ps[1:]}
        new = [*used.difference(self.known)]
        if len(self.known) + len(new) > self.MOST:  # what is in use now stays
            self.known = {p: self.known[p] for p in used.intersection(self.known)}
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.known.update(zip(part, self.count([" " + p for p in part]), strict=True))
        first = iter(self.count([ps[0] for ps in cut if ps]))
        known = self.known
        return [n if n >= 0 else next(first) + sum([known[p] for p in ps[1:]]) if ps else 0 for n, ps in zip(out, cut, strict=True)]


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None, huge: int = 32_768, chunk: int = 16_384, overlap: int = 1_024) -> DataFrame:
    """Adds `out`, the number of tokens of each whole text, and `n_bytes` of its UTF-8.

    A column of the frame with the name of a new one is replaced.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c not in (out, "n_bytes")]
    src = df.select(*keep, F.octet_length(F.coalesce(df[text], F.lit(""))).cast("long").alias("n_bytes"), df[text].alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), f"`{out}` bigint"])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path, huge, chunk, overlap)
        for batch in batches:
            n = counter([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_bytes", out])

    return src.mapInArrow(run, schema)
