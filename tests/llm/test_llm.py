import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from ravelin.llm import bpe, chat, decontaminate, fingerprints, ngram_join, quality, substring_dedup, token_counts, toxicity, url_filter
from ravelin.llm.queries import RULES, tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long"


def table(spark, texts):
    """Documents with columns whose names clash with results; None stands for a null text."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, 5) for i, t in texts], DOCS)


def vocabulary(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    r, v = random.Random(7), vocabulary(300)
    base = [" ".join(r.choice(v) for _ in range(r.randrange(1, 120))) for _ in range(60)]
    passage = " ".join(r.choice(v) for _ in range(55))
    out = list(base)
    for t in base[:20]:
        w = t.split()
        if len(w) > 8:
            w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [base[0], base[0], base[1], f"{base[2]} {passage} {base[3]}", f"{base[4]}\n{passage}", "", " \t", "x " * 70, "one", "LONG " + " ".join(v) * 30]
    rows = list(enumerate(out))
    r.shuffle(rows)
    return rows + [(500, None), (501, None)]


def test_tokens_and_bpe(spark, corpus):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = corpus + [(600, "a<|endoftext|> b"), (601, "\u3000x  y\n\n z"), (602, "日本語" * 200), (603, "ab" * 3000)]
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    df = table(spark, texts)
    for r in bpe.encode_decode(df, path).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
        assert r.decoded == lib.decode(want[r.doc_id], skip_special_tokens=False)
    for r in token_counts.count_tokens(df, path, huge=100, chunk=60, overlap=8).collect():
        assert r.n_tokens == len(want[r.doc_id])
    assert bpe.encode_decode(df.limit(0), path).count() == 0
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def brute_repeats(rows, window):
    seen, out = set(), {}
    for i, t in sorted((i, t or "") for i, t in rows):
        ws = t.split()
        mask = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            g = tuple(ws[p : p + window])
            if g in seen:
                mask[p : p + window] = [True] * window
            seen.add(g)
        out[i] = (len(ws), sum(mask), " ".join(w for w, m in zip(ws, mask, strict=True) if not m))
    return out


@pytest.mark.parametrize("window", [4, 20])
def test_substring_dedup(spark, corpus, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(table(spark, corpus), window).collect()}
    assert got == brute_repeats(corpus, window)
    assert sum(x[1] for x in got.values()) > 100
    assert substring_dedup.remove_repeats(table(spark, corpus).limit(0), window).count() == 0


def test_ngram_join(spark, corpus):
    sets = {}
    for i, t in corpus:
        ws = (t or "").lower().split()
        sets[i] = {tuple(ws[p : p + 4]) for p in range(len(ws) - 3)} if len(ws) > 3 else ({tuple(ws)} if ws else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(table(spark, corpus), 4, 85, 100).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}
    assert len(set(comp.values())) < len(comp) - 5
    assert ngram_join.join_components(table(spark, corpus).limit(0), 4, 85, 100).count() == 0


def test_tree_bound_never_loses_a_link():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.permutation(base)[: 400 - k], r.integers(0, 1 << 63, k).astype(np.uint64)])) for k in range(0, 90, 2)]
    n, sig = np.array([len(s) for s in sets]), np.stack([ngram_join.bitmap(s) for s in sets])
    got = set(ngram_join.traverse(np.arange(len(sets)), n, sig, np.arange(len(sets)), 85, 100, False))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            c = len(np.intersect1d(sets[a], sets[b]))
            if 100 * c >= 85 * (n[a] + n[b] - c):
                assert (a, b) in got


def test_fingerprints(spark, corpus):
    rows = sorted(((i, t or "") for i, t in corpus), reverse=True)
    got = {r.doc_id: r for r in fingerprints.near_copies(table(spark, corpus)).collect()}
    gaps = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = fingerprints.edit(t, nxt)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b = Counter(t.split()), Counter(e.split())
        if a and b:
            gaps.append(got[i].near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.08
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert fingerprints.near_copies(table(spark, corpus).limit(0)).count() == 0


def test_classifiers(spark):
    r, v = random.Random(5), vocabulary(200, 2)
    texts, labels = [], []
    for i in range(400):
        ws = [r.choice(v) for _ in range(40)]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            ws[r.randrange(40)] = "moronhead"
        if bad:
            ws = [w.upper() + "!!" for w in ws]
        texts.append((i, " ".join(ws)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train, docs = lab.filter("doc_id < 300"), table(spark, [*texts, (900, None), (901, "")])
    q = {r.doc_id: r.score for r in quality.score_quality(docs, train).collect()}
    x = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, train).collect()}
    assert all((q[i] >= 0.3) == bool(y) for i, y, _ in labels if i >= 300)
    assert all((x[i] >= 0.5) == bool(y) for i, _, y in labels if i >= 300)
    assert all(0 <= z <= 1 for z in [*q.values(), *x.values()]) and len(q) == 402 == len(x)
    assert quality.score_quality(docs.limit(0), train).count() == 0 and toxicity.score_toxicity(docs, lab.limit(0)).count() == 402


def test_counterfactual_penalty_frees_neutral_mentions():
    r, v = random.Random(9), vocabulary(60, 4)
    texts, y = [], []
    for i in range(300):
        toxic = i % 3 == 0
        ws = [r.choice(v) for _ in range(12)]
        ws[3] = "muslims" if toxic and i % 2 else r.choice(["christians", "jews", "hindus"]) if i % 2 else ws[3]
        if toxic:
            ws[6] = "vile"
        texts.append(" ".join(ws) + ".")
        y.append(float(toxic))
    f, pairs = [toxicity.text_features(t) for t in texts], [p for t in texts for p in toxicity.swaps(t)]
    with_, without = (toxicity.Scorer(*toxicity.train(f, np.array(y), pairs, strength=s)) for s in (50.0, 0.0))
    plain, named = "abc def ghi.", "abc muslims ghi."
    gap = lambda s: abs(s(named) - s(plain))
    assert gap(with_) < gap(without) and with_(named) < 0.5 < with_("they are vile muslims") + 0.2


def test_url_filter(spark):
    urls = ["http://A.example.com/en/1", "https://www.example.com/en/2", "http://x.net/es/3?a=/b", "http://x.net/de/4", "no url", None, "http://example.com", "http://xcom/", "ftp://example.com/en/a://b#x"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/2", "www.example.com/en/"), ("x.net", "/es/3", "net/es/"), ("x.net", "/de/4", None),
        ("", "", None), ("", "", None), ("example.com", "", None), ("xcom", "/", None), ("example.com", "/en/a://b", "example.com/en/"),
    ]
    assert {got[i].verdict for i in (0, 2, 8)} == {"block"} and {got[i].verdict for i in (1, 3, 4, 5)} == {"allow"}


def test_edit_distance():
    def slow(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(lo, 40))) for lo in (1, 0))
        assert decontaminate.best_edits(a, b)[0] == slow(a, b)


def test_decontamination(spark):
    r, v = random.Random(11), vocabulary(400, 6)
    items = [" ".join(r.choice(v) for _ in range(30)) for _ in range(20)]
    texts, want = [], set()
    for i in range(120):
        ws = [r.choice(v) for _ in range(100)]
        if i % 3 == 0:
            leak = items[i % 20].split()
            if i % 2:
                leak[r.randrange(30)] = "zz"
                del leak[r.randrange(30)]
            ws[50:50] = leak
            want.add((i, i % 20))
        texts.append((i, " ".join(ws)))
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id long, text string")
    docs = table(spark, [*texts, (900, None), (901, "")])
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, bench).collect()} == want
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, _ in texts if i % 3} | {900, 901}


def brute_repair(roles):
    best = {0: 0.0}
    for r in roles:
        nxt = {}
        for a, c in best.items():
            for b in (1, 2, 3):
                if chat._STEPS[a][b][0] < chat.INF:
                    nxt[b] = min(nxt.get(b, chat.INF), c + chat._STEPS[a][b][0] + chat.naming(r, b))
        best = nxt
    return min(best.values())


def test_chat(spark, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(chat, "BLOCK", 4)
    rows, convs = [], {}
    for c in range(40):
        convs[c] = [r.choice(["user", "assistant", "system", "bot", None]) for _ in range(r.randrange(1, 20))]
        rows += [(c, k, role, f"t{k}" if k % 3 else None) for k, role in enumerate(convs[c])]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for c, roles in convs.items():
        mine = sorted((x for x in got if x.conv_id == c), key=lambda x: x.turn)
        assert sum(x.cost for x in mine) == pytest.approx(brute_repair(roles))
        text = "".join(x.rendered for x in mine)
        opened = [p.split("\n")[0] for p in text.split("<|im_start|>")[1:]]
        assert text.count("<|im_end|>") == len(opened)
        if opened[0] == "system":
            opened = opened[1:]
        assert all(o == ("user", "assistant")[k % 2] for k, o in enumerate(opened))


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    docs = table(spark, corpus).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(i, 1, 0) for i, _ in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "nothing of this is in there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 50 < len(out) < len(corpus) and all(len(r.ids) == r.n_tokens for r in out)


def test_text_hasher_follows_the_word_pattern():
    from ravelin.llm.common import WORD, TextHasher, ascii_lower

    hasher, seen = TextHasher(fold=True), {}
    for text in ("A\x1c\x1d\x85\xa0  B \x0b\x0cÉÀ\x00 Z a b", "", " \n ", None, "ab ba aab aba " * 40_000, "x" * 300_000 + " y " + "x" * 300_000):
        found = WORD.findall(ascii_lower(text)) if text else []
        hashes = hasher(text).tolist()
        assert len(found) == len(hashes)
        for word, h in zip(found, hashes, strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_routes_meet_as_often_as_the_sets_are_alike():
    from ravelin.llm.common import mix
    from ravelin.llm.ngram_join import ROUTES, routes

    salts, rng = mix(np.arange(1, ROUTES + 1, dtype=np.uint64)) | np.uint64(1), np.random.default_rng(1)
    met = []
    for _ in range(1000):
        a = rng.integers(0, 2**63, 200, dtype=np.uint64)
        b = np.concatenate([a[16:], rng.integers(0, 2**63, 16, dtype=np.uint64)])
        met.append((routes(a, salts) == routes(b, salts)).sum())
    assert abs(np.mean(met) / ROUTES - 184 / 216) < 0.02 and min(met) > 4
