"""The tree of path templates against a plain version, and on pages whose method must decide."""

import random
import re
from collections import Counter, defaultdict

import pytest
from ravelin.llm import url_filter
from ravelin.llm.common import Scratch
from ravelin.llm.queries import RULES, op4_url_filter

WILD = re.compile(r"^(\{[nhx]\}|\*\*)")


def purity_of(blocked, labelled, parent):
    return (blocked + url_filter.WEIGHT * parent) / (labelled + url_filter.WEIGHT)


def differs(share, among, pooled, size):
    return abs(share - pooled) > url_filter.Z * (max(pooled * (1 - pooled), 1 / size) / among) ** 0.5


def kind(segs, d):
    nxt = segs[d + 1] if len(segs) > d + 1 else None
    form = "" if nxt is None else WILD.match(nxt)[1] if WILD.match(nxt) else "w"
    return f"{len(segs) - d - 1}{form}"


def brute(urls):
    """(host, segs) -> (template, purity), node by node from the root of each host."""
    out = {}

    def visit(rows, d, template, chain):
        """chain: (blocked, labelled) of the nodes from the host down to this one's parent."""
        labels = [v for _, v in rows if v]
        chain = [*chain, (labels.count("block"), len(labels))]
        p = url_filter.PRIOR
        for (b, n), (b1, n1) in zip(chain, chain[1:]):
            p = purity_of(b - b1, n - n1, p)
        p = purity_of(*chain[-1], p)
        branches = defaultdict(list)
        for segs, v in rows:
            if len(segs) == d:
                out[host, segs] = (template, p)
            else:
                branches[segs[d]].append((segs, v))
        literal = [c for c in branches if not WILD.match(c)]
        if len(literal) >= url_filter.VARIED and sum(len(branches[c]) for c in literal) < url_filter.REPEAT * len(literal):
            branches["*"] = [r for c in literal for r in branches.pop(c)]
        kinds = {c: Counter(kind(s, d) for s, _ in rs) for c, rs in branches.items()}
        pools = defaultdict(list)
        for c in branches:
            pools[tuple(sorted(kinds[c]))].append(c)
        joined = []
        for members in pools.values():
            if len(members) < 2:
                continue
            pooled = [r for c in members for r in branches[c]]
            of_kind, labelled = Counter(kind(s, d) for s, _ in pooled), [v for _, v in pooled if v]
            for c in members:
                mine = [v for _, v in branches[c] if v]
                other = bool(mine) and differs(mine.count("block") / len(mine), len(mine), labelled.count("block") / len(labelled), len(labelled))
                n = len(branches[c])
                if not other and not any(differs(x / n, n, of_kind[k] / len(pooled), len(pooled)) for k, x in kinds[c].items()):
                    joined.append(c)
        if joined:
            branches["{~}"] = [r for c in joined for r in branches.pop(c)]
        for c, rs in branches.items():
            visit(rs, d + 1, f"{template}/{c}", chain)

    by_host = defaultdict(list)
    for host, segs, v in urls:
        by_host[host].append((segs, v))
    for host, rows in by_host.items():
        visit(rows, 0, "", [])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_is_the_plain_one(spark, seed):
    r, urls = random.Random(seed), []
    for _ in range(900):
        host = r.choice(["a.net", "b.org", "hot"] + ["hot"] * 2 + ["wide"])
        first = f"w{r.randrange(90)}" if host == "wide" else r.choice(["en", "de", "es", "fr", "{n}", f"w{r.randrange(40)}"])
        segs = (first, *[r.choice(["x", "y", "{n}", "{h}.html", f"z{r.randrange(30)}"]) for _ in range(r.choice([0, 1, 1, 2, 2, 4]))])
        verdict = r.choice(["block", "block", "allow"]) if first in ("es", "fr") else r.choice([None, None, None, "allow"])
        urls.append((host, segs if r.random() > 0.02 else (), verdict))
    df = spark.createDataFrame([(h, list(s), v) for h, s, v in urls], "host string, segs array<string>, verdict string")
    got = {(x.host, tuple(x.segs)): (x.template, x.purity) for x in url_filter.templates(df, Scratch(spark)).collect()}
    want = brute(urls)
    assert got.keys() == want.keys() and any("{~}" in t for t, _ in want.values()) and any("*" in t for t, _ in want.values())
    for k, (template, purity) in want.items():
        assert got[k][0] == template and got[k][1] == pytest.approx(purity)


def test_labels_reach_what_no_rule_covers(spark):
    """x.net's ruled branches are all blocked and its others look like them; y.org has no labels."""
    urls = [f"https://x.net/{lang}/{n}" for lang in ("es", "fr", "de", "en") for n in range(20)] + [f"https://y.org/{lang}/{n}" for lang in ("es", "de") for n in range(20)]
    urls += ["https://x.net/about/us/team/all"] + [None, "", "nothing", "https://x.net/" + "a/" * 3000 + "b"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").selectExpr("*", "'x' as host", "1 as purity"), RULES).collect()
    assert len(got) == len(urls) + 1
    free = {urls[x.page_id]: x for x in got if x.rule is None}
    assert all(x.verdict == ("block" if u.startswith("https://x.net/") else "allow") for u, x in free.items() if u and re.search(r"/(de|en|es)/\d+$", u))
    assert free["https://x.net/de/3"].template == "/{~}/{n}" and free[None].verdict == free[""].verdict == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_the_method_decides_given_pages(spark):
    out = op4_url_filter(spark, "/root/testdata/sf0.01").collect()
    free = [x for x in out if x.rule is None]
    assert {x.verdict for x in free} == {"allow", "block"}
    assert all((x.purity >= url_filter.REJECT) == (x.verdict == "block") for x in free)
