"""Cut vertices and communities of components that no one task holds, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import biconnected, graph, modularity


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_graph(rng, n, extra):
    """Trees of trees with some more edges, loops and repeated edges."""
    edges = [(k, rng.randrange(max(0, k - 5), k)) for k in range(1, n)]
    edges += [(rng.randrange(n), rng.randrange(n)) for _ in range(extra)]
    return edges + edges[:3] + [(b, a) for a, b in edges[3:6]] + [(2, 2)]


@pytest.mark.parametrize("kind", ["random", "chain", "cliques"])
def test_distributed_cut_vertices(spark, kind):
    rng = random.Random(7)
    edges = {
        "random": lambda: random_graph(rng, 120, 25), "chain": lambda: [(k, k + 1) for k in range(150)] + [(20, k) for k in range(200, 260)] + [(300 + k, 300 + (k + 1) % 40) for k in range(40)] + [(5, 300)],
        "cliques": lambda: [(10 * c + i, 10 * c + j) for c in range(8) for i in range(6) for j in range(i)] + [(10 * c, 10 * c + 11) for c in range(7)],
    }[kind]()
    named = [(f"n{a:04d}", f"n{b:04d}") for a, b in edges] + [("z1", "z2"), ("z2", "z3")]
    df = spark.createDataFrame(named, "source string, target string")
    want = sorted((x,) for x in graph._cut_vertices([e for e in named if not e[0].startswith("z")]) + ["z2"])
    assert rows(graph.cut_vertices(df, one_task_edges=0)) == want
    assert rows(graph.cut_vertices(df)) == want


def test_forest_and_places_of_a_random_graph(spark):
    rng = random.Random(8)
    edges = [(a, b) for a, b in random_graph(rng, 90, 30)] + [(200, 201), (201, 202)]
    e = spark.createDataFrame(edges, "u long, v long")
    trees = biconnected.spanning_forest(e)
    got = trees.collect()
    assert len(got) == (90 - 1) + 2 and {frozenset(r) for r in got} <= {frozenset(x) for x in edges}
    nodes = {r["node"]: r for r in biconnected.rooted(trees).collect()}
    assert set(nodes) == {*range(90), 200, 201, 202} and {k for k, r in nodes.items() if r["parent"] is None} == {0, 200}
    for k, r in nodes.items():
        if r["parent"] is not None:
            p = nodes[r["parent"]]
            assert p["first"] < r["first"] <= r["last"] < p["last"]


def plain_modularity(edges, label):
    m = sum(w for *_, w in edges)
    degree, inside = {}, 0.0
    for a, b, w in edges:
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0.0) + w
        inside += w * (label[a] == label[b])
    return inside / m - sum(d * d for d in degree.values()) / (4 * m * m)


@pytest.mark.parametrize("kind", ["planted", "ring"])
def test_distributed_communities_are_as_good(spark, kind):
    """At least 0.95 of the modularity of the one-task version, the same at every run, connected to the least node's name."""
    rng = random.Random(9)
    if kind == "planted":
        pairs = [(a, b) for a in range(120) for b in range(a) if rng.random() < (0.5 if a % 6 == b % 6 else 0.02)]
    else:
        pairs = [(12 * c + i, 12 * c + j) for c in range(8) for i in range(12) for j in range(i) if rng.random() < 0.7 or i == j + 1] + [(12 * c, (12 * c + 13) % 96) for c in range(8)]
    edges = [(f"v{a:03d}", f"v{b:03d}", 100.0 + rng.randrange(100)) for a, b in pairs] + [("x", "y", 300.0)]
    hits = spark.createDataFrame(edges, "query string, target string, bits double")
    one = {r["node_id"]: r["community"] for r in graph.communities(hits).collect()}
    many = {r["node_id"]: r["community"] for r in graph.communities(hits, one_task_edges=0).collect()}
    kept = [e for e in edges if e[2] > 100]
    assert set(many) == set(one) and all(c == min(x for x in many if many[x] == c) for c in many.values())
    got, want = plain_modularity(kept, many), plain_modularity(kept, one)
    assert got >= 0.95 * want > 0.3
    labels = spark.createDataFrame(list(many.items()), "node_id string, community string")
    own = spark.createDataFrame(kept, "source string, target string, weight double")
    assert modularity.modularity(own, labels).first()[0] == pytest.approx(got, abs=1e-12)
    alone = modularity.modularity(own, labels.where("false")).first()[0]
    assert alone == pytest.approx(plain_modularity(kept, {x: x for x in many}), abs=1e-12)


def test_small_components_share_a_python_call(spark):
    """Components cut over Arrow batches are whole; millions of small ones are no call each."""
    rng, named = random.Random(3), []
    for c in range(40):
        n = rng.choice([2, 3, 9])
        named += [(f"c{c:02d}n{k}", f"c{c:02d}n{rng.randrange(k)}", 200.0) for k in range(1, n)]
    hits = spark.createDataFrame(named, "query string, target string, bits double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = graph.communities(hits)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
        got = rows(found)
        assert rows(graph.cut_vertices(hits.toDF("source", "target", "bits"))) == sorted((x,) for x in graph._cut_vertices([e[:2] for e in named]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for c in range(40):
        own = [(min(a, b), max(a, b), w) for a, b, w in named if a.startswith(f"c{c:02d}")]
        for x, k in graph._louvain(own, 200.0 * len(named), 42).items():
            want.setdefault((c, k), []).append(x)
    assert got == sorted((x, min(own)) for own in want.values() for x in own)


def test_no_sweep_lowers_the_modularity(spark):
    """Two nations that both gain by joining their region do not join it at once; 40 suppliers of a nation do. Numbers of nodes do not follow the partitions."""
    edges = [(f"S{k:03d}", f"N{k % 10}", 200.0) for k in range(400)] + [(f"N{k}", f"R{k % 2}", 200.0) for k in range(10)] + [("R0", "R1", 200.0)]
    by_nation = {x: b if a[0] == "S" else x for a, b, _ in edges for x in (a, b)} | {f"S{k:03d}": f"N{k % 10}" for k in range(400)} | {"R0": "N0", "R1": "N1"}
    least, hits = plain_modularity(edges, by_nation), spark.createDataFrame(edges, "query string, target string, bits double")
    own = {r["node_id"]: r["community"] for r in graph.communities(hits, seed=1, one_task_edges=0).collect()}
    assert plain_modularity(edges, own) >= least - 1e-9
    numbers = [rows(graph.with_numbers(hits.repartition(n).select(F.col("query").alias("source"), "target"))[1]) for n in (1, 7)]
    assert numbers[0] == numbers[1]
