"""Queries over everything, held against brute force on small tables."""

import random

import pytest
from ravelin.plans import catalog


@pytest.fixture(scope="module")
def imports(spark, tmp_path_factory):
    """A folder with a lineitem table of two-part orders, and its import edges (src, dst, uncertain)."""
    r = random.Random(3)
    edges = {(7, 300), (300, 301), (301, 302), (302, 303), (303, 300), (303, 304), (8, 9), (9, 8), (1000, 1001)} | {(304 + i, 305 + i) for i in range(12)}
    edges |= {(r.randrange(400, 440), r.randrange(400, 440)) for _ in range(110)}
    edges = {(a, b): r.random() < 0.5 for a, b in edges if a != b}
    rows = [(k, n, p, 0.01 if unc else 0.05, "F") for k, ((a, b), unc) in enumerate(sorted(edges.items())) for n, p in ((1, a), (2, b))]
    d = str(tmp_path_factory.mktemp("imports"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_discount double, l_linestatus string").write.parquet(f"{d}/lineitem.parquet")
    return d, edges


def below(edges, seeds, most=10**9):
    depth, front = dict.fromkeys(seeds, 0), set(seeds)
    for k in range(1, most + 1):
        front = {b for a, b in edges if a in front} - set(depth)
        if not front:
            break
        depth |= dict.fromkeys(front, k)
    return depth


def test_cycles_and_closure_take_all_imports(spark, imports):
    d, edges = imports
    reach = {a: set(below(edges, [b for x, b in edges if x == a])) for a, _ in edges}
    want = {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in reach if a in reach[a]}
    assert {300, 303, 8} <= set(want) and max(want) >= 400
    assert dict(catalog.whole_queries()["import_cycles_all"](spark, d).collect()) == want
    got = {r.node for r in catalog.whole_queries()["import_transitive_closure_all"](spark, d).collect()}
    assert got == set(below(edges, [a for a, _ in edges if a < 200])) and {300, 316} <= got


def test_searches_go_to_the_reference_depths(spark, imports):
    d, edges = imports
    both = set(edges) | {(b, a) for a, b in edges}
    want = below(both, [7], 5)
    assert dict(catalog.whole_queries()["blast_radius_full"](spark, d).collect()) == want and max(want.values()) == 5
    near = {v for v, k in want.items() if k < 5}
    risky = {tuple(r) for r in catalog.whole_queries()["risky_edges_full"](spark, d).collect()}
    assert risky == {e for e, unc in edges.items() if unc and near & set(e)}
    far = below(both, [7], 10)
    assert [tuple(r) for r in catalog.whole_queries()["trace_shortest_path_len_full"](spark, d).collect()] == [(len(far), 10, sum(far.values()))]


def test_claims_are_all_ranked(spark, tmp_path):
    # 200 users with a claim each and nine kinds of evidence
    rows = [(u * 1000 + k, u) for u in range(200) for k in range(9)]
    spark.createDataFrame(rows, "event_id long, user_id long").selectExpr("*", "timestamp'2024-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    d = str(tmp_path)
    claims = catalog._claims(spark, d).filter("band_no >= 2 and status <> 'rejected'").select("band_no", "claim_id", "band").collect()
    want = [(c, b, k) for k, (_, c, b) in enumerate(sorted((-n, c, b) for n, c, b in claims), 1)]
    got = sorted((tuple(r) for r in catalog.queries()["list_claims_ranked"](spark, d).collect()), key=lambda r: r[2])
    assert got == want and len(got) > 50
