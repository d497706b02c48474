"""Sensitive search: recall at low identity, growth, frequent seeds, banded extension; pairs of heavy keys."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from kinweave.operators import graph, joins, similarity

TABLE = [list(map(int, r.split())) for r in similarity.BLOSUM62.strip().splitlines()]
RESIDUES = similarity.RESIDUES[:20]
#: usual shares of the residues, in the same order
SHARES = (8.3, 5.5, 4.1, 5.5, 1.4, 3.9, 6.7, 7.1, 2.3, 5.9, 9.7, 5.8, 2.4, 3.9, 4.7, 6.6, 5.3, 1.1, 2.9, 6.9)


def made(rng, n):
    return "".join(rng.choices(RESIDUES, SHARES, k=n))


def relative(rng, text, identity, indels=1):
    """A sequence of that identity: others replace residues as often as the matrix says."""
    out = []
    for c in text:
        x = RESIDUES.index(c)
        w = [0 if y == x else SHARES[y] * math.exp(0.3466 * TABLE[x][y]) for y in range(20)]
        out.append(c if rng.random() < identity else rng.choices(RESIDUES, w)[0])
    for _ in range(indels):
        k = rng.randrange(len(out))
        out[k : k + rng.choice((0, 1, 2))] = list(made(rng, rng.choice((0, 1, 2))))
    return "".join(out)


def families(rng, n, of=2, identity=(0.3, 0.5), length=170):
    rows = []
    for k in range(n):
        base = made(rng, length)
        rows += [(f"f{k}_0", base)] + [(f"f{k}_{j}", relative(rng, base, rng.uniform(*identity))) for j in range(1, of)]
    return rows


def test_recall_at_30_to_50_percent_identity(spark):
    rng = random.Random(1)
    rows = families(rng, 150)
    seqs = spark.createDataFrame(rows, "name string, sequence string")
    params = similarity.SearchParams(min_identity=0.25)
    found = {(r["query"], r["target"]): r["pident"] for r in similarity.align(seqs, params).collect()}
    text = dict(rows)
    pairs = [(f"f{k}_0", f"f{k}_1") for k in range(150)]
    full = similarity.local_alignments([(text[a], text[b]) for a, b in pairs])
    size = sum(map(len, text.values()))
    want = {}
    for (a, b), (score, same, columns, sa, ea, sb, eb) in zip(pairs, full.tolist(), strict=True):
        bits = (similarity.LAMBDA * score - math.log(similarity.K)) / math.log(2)
        if size * len(text[a]) * 2.0**-bits <= 1e-5 and same / columns >= 0.25 and (ea - sa) / len(text[a]) >= 0.8 and (eb - sb) / len(text[b]) >= 0.8:
            want[a, b] = 100 * same / columns
    assert len(want) > 100 and np.mean(list(want.values())) < 45
    hit = [p for p in want if p in found]
    assert len(hit) >= 0.9 * len(want)
    assert all(abs(found[p] - want[p]) < 1e-6 for p in hit)  # the band holds the whole alignment
    assert {a.split("_")[0] for a, _ in found} and all(a.split("_")[0] == b.split("_")[0] for a, b in found)


def test_candidates_grow_with_the_sequences(spark):
    counts = []
    for n in (40, 400):
        seqs = spark.createDataFrame(families(random.Random(2), n, of=5), "name string, sequence string")
        counts.append(similarity.extended_pairs(seqs, similarity.SearchParams()).count())
    assert counts[1] <= 12 * counts[0] and counts[0] > 150
    # places that meet by chance stay as many when the residues grow a thousandfold
    assert [len(similarity.seed_places(n)[0]) for n in (10**5, 10**7, 10**9)] == [5, 6, 8]
    assert all(n * similarity.ALIKE ** len(similarity.seed_places(n)[0]) <= 15 for n in (10**5, 10**7, 10**9, 10**12))
    assert similarity.seed_places(10**9)[0] == (0, 1, 2, 4, 6, 8, 9, 11)


def test_banded_alignments_equal_whole_ones_near_the_diagonal():
    rng = random.Random(3)
    pairs, diagonals = [], []
    for _ in range(60):
        a = made(rng, rng.randint(40, 160))
        lead, tail = made(rng, rng.randint(0, 50)), made(rng, rng.randint(0, 50))
        b = lead + relative(rng, a, 0.7, indels=2) + tail
        x, y = (a, b) if rng.random() < 0.5 else (b, a)
        pairs.append((x, y))
        diagonals.append(-len(lead) if x == a else len(lead))
    whole, near = similarity.local_alignments(pairs), similarity.local_alignments(pairs, np.array(diagonals), 12)
    assert (whole == near).all()
    assert (similarity.local_alignments(pairs, np.array(diagonals), 500) == whole).all()
    plain = []
    for (a, b), d in zip(pairs, diagonals, strict=True):
        best = run = top = 0
        for i, c in enumerate(a):
            if 0 <= i - d < len(b):
                run += TABLE[similarity.RESIDUES.index(c)][similarity.RESIDUES.index(b[i - d])]
                if run <= 0 or run < top - 20:
                    run = top = 0
                top = max(top, run)
                best = max(best, top)
            else:
                run = top = 0
        plain.append(best)
    assert similarity.ungapped_scores(pairs, np.array(diagonals), 20).tolist() == plain


def test_heavy_keys_are_split_over_tasks(spark):
    """One key of most rows: every pair once, in many even groups."""
    rows = [(0, k, k % 7) for k in range(3000)] + [(1 + k % 50, 3000 + k, 0) for k in range(400)]
    df = spark.createDataFrame(rows, "key int, id int, x int")
    pairs = joins.self_pairs(df, ["key"], "id", ("x",), block_rows=200)
    got = pairs.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("id_a", "id_b").alias("d"), F.min(F.col("id_b") - F.col("id_a")).alias("least"), F.count_if(F.col("x_a") != F.when(F.col("id_a") < 3000, F.col("id_a") % 7).otherwise(0)).alias("wrong"))
    rows = {r["key"]: (r["n"], r["d"], r["least"] > 0, r["wrong"]) for r in got.collect()}
    assert rows[0] == (3000 * 2999 // 2, 3000 * 2999 // 2, True, 0)
    assert all(rows[1 + k] == (28, 28, True, 0) for k in range(50))
    names = joins.self_pairs(df.withColumn("id", F.col("id").cast("string")), ["key"], "id", block_rows=200).where("id_a >= id_b")
    assert names.count() == 0


def test_a_wide_cluster_is_split_evenly(spark, monkeypatch):
    counts = spark.range(1200).select(F.lit("c0").alias("chg"), F.concat(F.lit("g"), "id").alias("genome"), F.lit(1).alias("weight"))
    counts = counts.unionByName(spark.range(300).select(F.concat(F.lit("d"), (F.col("id") % 100).cast("string")).alias("chg"), F.concat(F.lit("g"), "id").alias("genome"), F.lit(2).alias("weight")))
    nodes, edges = graph.genome_network(counts)
    assert nodes.count() == 1200
    got = edges.agg(F.count("*"), F.sum("weight"), F.count_if(F.col("source") >= F.col("target"))).first()
    assert tuple(got) == (1200 * 1199 // 2, 1200 * 1199 // 2 + 300, 0)
    sizes = joins.self_pairs(counts.select("chg", "genome").distinct(), ["chg"], "genome", block_rows=100)
    assert sizes.count() == 1200 * 1199 // 2 + 300
