"""Trees of any depth: texts, depths, meeting points, means."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import tree

NODES = "node_id int, parent_id int, name string, length double, depth int, path array<int>"


def frame(spark, text):
    return spark.createDataFrame(tree.parse_newick(text), NODES)


def shape(text):
    """The tree as nested sorted tuples of names."""
    rows = tree.parse_newick(text)
    below = {}
    for i, parent, name, length, *_ in reversed(rows):
        own = (name or "", length, tuple(sorted(below.get(i, []), key=repr)))
        below.setdefault(parent, []).append(own)
    return below[None][0]


def test_a_caterpillar_of_50000_nodes(spark):
    n = 25_000
    text = "(" * n + "a0" + "".join(f",a{k}:2)" for k in range(1, n + 1)) + ";"
    nodes = frame(spark, text)
    assert nodes.count() == 2 * n + 1 and nodes.where("path is not null").count() == 0
    assert tree.depths(nodes).join(nodes.select("node_id", F.col("depth").alias("d")), "node_id").where("depth <> d").count() == 0
    keyed = nodes.select(F.format_string("%09d", "node_id").alias("key"), F.when(F.col("parent_id").isNotNull(), F.format_string("%09d", "parent_id")).alias("parent_key"), "name", F.when(F.col("name").startswith("a") & (F.col("name") != "a0"), 2.0).alias("length"))
    again = tree.newick_text(keyed).first()["value"]
    rows = {(r[2], r[4]) for r in tree.parse_newick(again)}
    assert rows == {(r[2] or None, r[4]) for r in tree.parse_newick(text)} and again.count("(") == n
    pairs = spark.createDataFrame([("a0", "a1"), ("a0", f"a{n}"), ("a5", "a1000"), ("a7", "a7"), ("a3", "none")], "genome_a string, genome_b string")
    got = {(r["genome_a"], r["genome_b"]): r["N_int"] for r in tree.pair_distances(nodes, pairs).collect()}
    assert got == {("a0", "a1"): 1, ("a0", f"a{n}"): n, ("a5", "a1000"): 996}
    one = tree.mean_distance(nodes).first()
    total = sum(k for k in range(1, n + 1)) + sum((n - j) * (n - j + 1) // 2 + (n - j) for j in range(1, n))  # a0 with ak: k; aj with ak: k - j + 1
    assert one["leaf_count"] == n + 1 and one["n_int_mean"] == pytest.approx(total / (n * (n + 1) / 2), rel=1e-9)


def test_both_ways_agree_on_a_random_tree(spark, monkeypatch):
    rng = random.Random(4)
    parts = [f"t{k}" for k in range(40)]
    while len(parts) > 1:
        k = rng.randint(1, min(3, len(parts)))
        own = [parts.pop(rng.randrange(len(parts))) for _ in range(k)]
        parts.append(f"({','.join(f'{x}:{rng.randint(1, 9)}' for x in own)})" + rng.choice(["", "inner", "'a b'"]))
    text = parts[0] + ";"
    flat = frame(spark, text)
    monkeypatch.setattr(tree, "LONGEST_PATH", 0)
    deep = frame(spark, text)
    assert deep.where("path is not null").count() == 0 and flat.where("path is null").count() == 0
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tree.leaf_distances(deep)) == rows(tree.leaf_distances(flat))
    assert tree.mean_distance(deep).first()["n_int_mean"] == pytest.approx(tree.mean_distance(flat).first()["n_int_mean"])
    again = tree.newick_text(flat.select(F.format_string("%05d", "node_id").alias("key"), F.when(F.col("parent_id").isNotNull(), F.format_string("%05d", "parent_id")).alias("parent_key"), "name", "length")).first()["value"]
    assert shape(again) == shape(text)
    few = [("r", None, "Root"), ("r|b", "r", "b c"), ("r|a", "r", "it's"), ("r|a|x", "r|a", "x")]
    table = spark.createDataFrame(few, "key string, parent_key string, name string")
    assert tree.newick_text(table).first()["value"] == tree.to_newick(few) == "((x:1)'it''s':1,'b c':1)Root;"
    assert tree.newick_text(table.where("key = 'r'")).first()["value"] == "Root;"
