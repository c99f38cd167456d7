"""Parts of the job that earlier versions left out."""

import hashlib
import random

import pytest
from ravelin.llm import decontaminate, ngram_join, substring_dedup


def vocabulary(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n)]


def documents(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def edited(r, text, rate):
    x = list(text)
    for _ in range(int(rate * len(x))):
        i, how = r.randrange(len(x)), r.randrange(3)
        if how:
            x[i : i + how - 1] = [r.choice("abcdefgh ")]
        else:
            del x[i]
    return "".join(x)


@pytest.mark.parametrize("rate", [0.1, 0.18, "third word", "second word"])
def test_items_are_found_up_to_the_limit(rate):
    """Letters anywhere edited, or one wrong letter in every second or third word."""
    r, v = random.Random(4), vocabulary(400, 6)
    items = [" ".join(r.choice(v) for _ in range(40)) for _ in range(100)]
    texts, within = [], []
    for x in items:
        every = {"third word": 3, "second word": 2}.get(rate)
        e = " ".join("z" + w[1:] if n % every == 0 else w for n, w in enumerate(x.split())) if every else edited(r, x, rate)
        texts.append(f"{' '.join(r.choice(v) for _ in range(30))} {e} {' '.join(r.choice(v) for _ in range(30))}")
        within.append(decontaminate.best_edits(x, " ".join(texts[-1].split()))[0] <= int(0.2 * len(x)))
    got = decontaminate.Items(list(enumerate(items)), 0.2).find(texts)
    assert sum(within) > 90
    assert sum(w and any(h[0] == k for h in hits) for k, (w, hits) in enumerate(zip(within, got, strict=True))) >= 0.98 * sum(within)


def test_items_without_spaces_and_very_long_ones():
    """An item of a script without spaces inside a longer run of it; an item of 50,000 characters with edits takes little memory."""
    import tracemalloc

    r = random.Random(12)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    item, v = han(80), vocabulary(500, 3)
    changed = item[:20] + han(4) + item[24:60] + item[62:]
    long = " ".join(r.choice(v) for _ in range(12_000))
    tracemalloc.start()
    items = decontaminate.Items([(1, item), (2, long[:50_000])], 0.2)
    found = items.find([han(300) + item + han(300), han(50) + changed + han(10), han(500), "x y z " + long[:20_000] + "zz" + long[20_010:] + " more"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [[h[0] for h in hits] for hits in found] == [[1], [1], [], [2]]
    assert peak < 200e6


def test_contamination_of_unusual_tables(spark):
    """Empty tables, an empty benchmark, repeated rows and items, null ids, and columns named like the operator's own."""
    item = "the quick brown fox jumps over the lazy dog and runs away into the deep dark forest"
    bench = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {item} b", 7), (1, f"a {item} b", 7), (2, "clean", 8), (None, item, 9), (3, None, 1)], "doc_id long, text string, edits long")
    found = decontaminate.find_items(docs, bench([(5, item), (5, item), (6, item.upper()), (7, "")])).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in found) == [(1, 5, 0), (1, 6, 0)]
    assert decontaminate.find_items(docs, bench([])).count() == 0 and decontaminate.find_items(docs.limit(0), bench([(5, item)])).count() == 0
    assert sorted(r.edits for r in decontaminate.drop_contaminated(docs, bench([(5, item)])).collect()) == [1, 8]
    assert decontaminate.drop_contaminated(docs, bench([])).count() == 5


def test_short_items_and_places():
    items = decontaminate.Items([(1, "a short item"), (2, "x")], 0.2)
    assert items.find(["well, a shirt item", "none of it", None, ""]) == [[(1, 1, 1, 1 - 1 / 12)], [], [], []]


@pytest.mark.parametrize("block", [1024, 3])
def test_links_are_all_counted(spark, monkeypatch, block):
    """Groups of near copies: each member has a link with each other it is alike to."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r, v, texts = random.Random(8), vocabulary(300), []
    for size in (1, 2, 9, 14):
        base = [r.choice(v) for _ in range(130)]
        for _ in range(size):
            w = list(base)
            w[r.randrange(130)] = r.choice(v)
            texts.append(" ".join(w))
    texts += [texts[5], texts[5].upper(), "", "alone"]
    sets = [{tuple(w[p : p + 4]) for p in range(max(1, len(w) - 3))} if (w := t.lower().split()) else set() for t in texts]
    distinct = {frozenset(s) for s in sets if s}
    want = {i: sum(s != o and 100 * len(s & o) >= 85 * len(s | o) for o in distinct) if s else 0 for i, s in enumerate(sets)}
    got = {x.doc_id: x.n_links for x in ngram_join.join_components(documents(spark, [*enumerate(texts), (90, None)]), 4, 85, 100).collect()}
    assert got == want | {90: 0} and max(want.values()) > 5


def test_rows_without_an_id_keep_their_words(spark):
    r, v = random.Random(2), vocabulary(300)
    passage = " ".join(r.choice(v) for _ in range(30))
    texts = [(1, f"one {passage} here"), (2, f"two {passage} there"), (None, f"three {passage} gone")]
    got = {x.doc_id: x for x in substring_dedup.remove_repeats(documents(spark, texts).coalesce(1), 20).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[None].n_removed) == (0, 30, 0) and got[None].kept == texts[2][1]


def test_the_pipeline_decodes_what_it_encodes(spark):
    import corpus_pipeline

    texts = {1: "Plain words, twice: words.", 2: "ñandú 日本語\n\n x", 3: ""}
    got = {x.doc_id: x for x in corpus_pipeline.encode(spark, documents(spark, list(texts.items())), "").collect()}
    assert {i: x.decoded_sha256 for i, x in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert all(len(x.ids) == x.n_tokens for x in got.values())
