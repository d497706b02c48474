"""Components of edges that stand near each other, and communities with known components."""

from __future__ import annotations

import random

import pytest

from kinweave.operators import graph


def brute(edges):
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    while True:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


@pytest.mark.parametrize("together", [3, 200_000])
@pytest.mark.parametrize("name", [str, int])
def test_components_of_near_edges(spark, monkeypatch, together, name):
    monkeypatch.setattr(graph, "EDGES_TOGETHER", together)
    rng = random.Random(together)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, 500), (7, 900), (901, 7)]
    edges = [(name(a), name(b)) for a, b in edges]
    rng.shuffle(edges)
    kind = "string" if name is str else "long"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        d = spark.createDataFrame([*edges, (None, edges[0][0])], f"u {kind}, v {kind}").repartition(5)
        got = graph.components_of_near(d, "u", "v").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == brute(edges)


def test_no_edges(spark):
    assert graph.components_of_near(spark.createDataFrame([], "u string, v string"), "u", "v").count() == 0


def test_communities_of_single_edges_are_those_of_louvain(spark):
    rng = random.Random(5)
    rows = [(f"a{k}", f"b{k}", rng.choice([150.0, 194.5, 200.0])) for k in range(30)] + [("x", "x", 200.0), ("c1", "c2", 180.0), ("c2", "c3", 181.0), ("b1", "a1", 120.0)]
    hits = spark.createDataFrame(rows, "query string, target string, bits double")
    edges = [tuple(r) for r in graph.strong_edges(hits, 100.0).collect()]
    total = sum(w for *_, w in edges)
    want = {}
    for own in {c: [e for e in edges if part[e[0]] == c] for part in [brute([e[:2] for e in edges])] for c in set(part.values())}.values():
        found = graph._louvain(own, total, 42)
        least = {}
        for x in sorted(found):
            least.setdefault(found[x], x)
        want |= {x: least[c] for x, c in found.items()}
    known = graph.strong_components(hits, 100.0)
    for comps in (None, known):
        assert {r["node_id"]: r["community"] for r in graph.communities(hits, 100.0, comps=comps).collect()} == want
