"""Similar sets: exact thresholds, groups cut into blocks, two tables, sets without the features that no other set has."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import similarity
from kinweave.runtime import materialize


def texts_of(seed: int, n: int):
    rng = random.Random(seed)
    base = [[f"b{k}w{i}" for i in range(rng.randrange(20, 60))] for k in range(6)]
    out = []
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 3, 8))):
            t[rng.randrange(len(t))] = f"x{rng.randrange(400)}"
        out.append((k, " ".join(t)))
    return out + [(n, " ".join(f"alone{k}" for k in range(40))), (n + 1, "too short"), (n + 2, None)]


def brute(texts, least, words=5):
    own = {}
    for k, t in texts:
        w = (t or "").split(" ")
        if len(w) >= words:
            own[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    found = {(a, b): 100.0 * len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a < b}
    return {p: v for p, v in found.items() if v >= least}


def test_pairs_of_exactly_the_threshold(spark):
    """0.55 * 100 is more than 55 in floating point, 55 of 100 features are 55 per cent nevertheless."""
    rows = [(k, x) for k, n in (("a", 100), ("b", 55), ("c", 54)) for x in range(n)]
    found = similarity.jaccard_join(spark.createDataFrame(rows, "name string, shingle string"), 55.0).collect()
    assert sorted((r["query"], r["target"]) for r in found) == [("a", "b"), ("b", "c")]


@pytest.mark.parametrize("least", [30.0, 55.0, 80.0])
@pytest.mark.parametrize("most", [4_000_000, 100])
def test_texts_by_brute_force(spark, monkeypatch, least, most):
    monkeypatch.setattr(similarity, "GROUP_FEATURES", most)
    rows = texts_of(7, 60)
    docs = spark.createDataFrame(rows, "id long, body string")
    want = brute(rows, least)
    found = similarity.jaccard_texts(docs, "id", "body", least).collect()
    assert len(found) == len({(r["query"], r["target"]) for r in found}) and want
    assert {(r["query"], r["target"]): r["pident"] for r in found} == pytest.approx(want)
    # two tables, whose names are the same
    sets = materialize(similarity.hashed_sets(docs, "id", "body"), "sets")
    both = similarity.linked_sets(sets.where("name < 30"), sets.where("name >= 20"), least).collect()
    assert {(r["query"], r["target"]) for r in both} == {(x, y) for a, b in want for x, y in ((a, b), (b, a)) if x < 30 and y >= 20}


def test_sets_hold_shared_features_only(spark):
    """What no other set has is neither grouped nor written; a set goes to its groups once, not to each of its pairs."""
    docs = spark.createDataFrame(texts_of(3, 40), "id long, body string")
    whole = similarity.hashed_sets(docs, "id", "body")
    often = {r["h"] for r in whole.select(F.explode_outer("s").alias("h")).groupBy("h").count().where("count > 1").collect()}
    want = {r["name"]: (r["size"], set(r["s"]) & often) for r in whole.collect()}
    got = {r["name"]: (r["size"], set(r["s"])) for r in similarity.shared_sets(whole).collect()}
    assert got == {k: v for k, v in want.items() if v[1]} and len(got) < len(want)


@pytest.mark.parametrize("least", [30.0, 80.0])
def test_long_texts_meet_often(spark, monkeypatch, least):
    """Pairs that meet in few features only are not verified, those that reach the threshold are all found."""
    rng, rows = random.Random(9), []
    base = [[f"b{k}w{i}" for i in range(rng.randrange(250, 300))] for k in range(3)]
    shared = [f"licence{i}" for i in range(9)]
    for k in range(30):
        t = list(rng.choice(base))
        for _ in range(rng.choice((0, 2, 6, 12, 30))):
            t[rng.randrange(len(t))] = f"x{rng.randrange(4000)}"
        rows.append((k, " ".join(t + shared)))
    asked = []
    monkeypatch.setattr(similarity, "_shared_counts", lambda pairs, *sets, own=similarity._shared_counts: asked.append(pairs.count()) or own(pairs, *sets))
    docs = spark.createDataFrame(rows, "id long, body string")
    want = brute(rows, least)
    sets = materialize(similarity.hashed_sets(docs, "id", "body"), "sets")  # in order of the hash: the shared runs stand anywhere
    assert {(r["query"], r["target"]): r["pident"] for r in similarity.linked_sets(sets, sets, least, same=True).collect()} == pytest.approx(want) and want
    assert least < 80 or asked[0] <= len(brute(rows, 10.0))
