"""Substring dedup over several shards, long texts and unusual rows, against brute force."""

import random

import pytest
from ravelin.llm import substring_dedup


def brute(rows, window):
    """Rows (doc_id, text): a window goes if its words start at a smaller (doc_id, position)."""
    first = {}
    for i, t in rows:
        ws = [w.decode() for w in (t or "").encode().split()]
        for p in range(len(ws) - window + 1):
            g = tuple(ws[p : p + window])
            if i is not None and (i, p) < first.get(g, (float("inf"), 0)):
                first[g] = (i, p)
    out = []
    for i, t in rows:
        ws = [w.decode() for w in (t or "").encode().split()]
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        out.append((i, len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("stream", [1 << 22, 700])
def test_several_shards(spark, monkeypatch, stream):
    """Copies, passages that many share, overlaps, loops in one text, null and repeated ids; passages longer than SEGMENT; automata fed piece by piece."""
    monkeypatch.setattr(substring_dedup, "SHARD", 3000)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 9)
    r = random.Random(21)
    v = [f"w{n}" for n in range(40)] + ["é", "日本", "\x85", "a\xa0b"]
    make = lambda n: [r.choice(v) for _ in range(n)]
    shared = [make(n) for n in (7, 30, 80)]
    rows = []
    for i in range(120):
        words = make(r.randrange(0, 60))
        for s in shared:
            if r.random() < 0.3:
                a = r.randrange(len(s) - 5)
                at = r.randrange(len(words) + 1)
                words[at:at] = s[a : r.randrange(a + 5, len(s) + 1)]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(words)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (2, rows[5][1]), (3, rows[3][1]), (None, rows[3][1]), (None, None), (203, "x " * 400), (204, "y x " * 300), (205, None), (206, "")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'a' as raw", "2 as shard", "3 as h")
    monkeypatch.setattr(substring_dedup, "STREAM", stream)
    got = substring_dedup.remove_repeats(df, 6)
    assert {"raw", "shard", "h"} <= set(got.columns)
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got.collect()), key=str) == brute(rows, 6)


def test_streaming_in_pieces_finds_the_same(monkeypatch):
    r = random.Random(5)
    text = b" ".join(r.choice([b"aa", b"b", b"cc"]) for _ in range(3000))
    windows = substring_dedup.rolling(substring_dedup._hasher().spans(text)[0], 8)
    blobs = [(1, a, b) for a, b in substring_dedup.passages_of(text, windows[100:200], 8, 6)]
    masks = []
    for stream in (1 << 22, 97):
        monkeypatch.setattr(substring_dedup, "STREAM", stream)
        masks.append(substring_dedup.Shard(blobs, 8).mask(2, text))
    assert masks[0][100:200].all() and (masks[0] == masks[1]).all()


def test_words_with_the_same_letters_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "letters", lambda h: "abc" * len(h))
    text = b"a b c d e f g h i j k l"
    windows = substring_dedup.rolling(substring_dedup._hasher().spans(text)[0], 8)
    shard = substring_dedup.Shard([(1, a, b) for a, b in substring_dedup.passages_of(text, windows, 8, 6)], 8)
    assert shard.mask(2, text).all() and not shard.mask(2, text.replace(b"f", b"z")).any()
    assert shard.mask(2, b"y " + text.replace(b"l", b"z") + b" x").tolist() == [False] + [True] * 11 + [False] * 2


def test_a_crowded_anchor_keeps_different_windows_with_the_same_letters(monkeypatch):
    """An earlier passage whose words have the same letters doesn't hide the one that the document repeats."""
    monkeypatch.setattr(substring_dedup, "letters", lambda h: "abc" * len(h))
    monkeypatch.setattr(substring_dedup, "CROWDED", 1)
    texts = [b"a b c d e f g h", b"i j k l m n o p"]
    windows = [substring_dedup.rolling(substring_dedup._hasher().spans(t)[0], 8) for t in texts]
    shard = substring_dedup.Shard([(i, a, b) for i, t in enumerate(texts) for a, b in substring_dedup.passages_of(t, windows[i], 8, 6)], 8)
    assert shard.mask(7, texts[0]).all() and shard.mask(7, texts[1]).all()
