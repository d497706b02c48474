"""Hand-made cases of the network operators."""

from __future__ import annotations

import random

import pytest

from kinweave.functions.scorers import ScoringMethod, scorer
from kinweave.operators import graph, ranking, similarity, stats, tree
from kinweave.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cut_vertices_by_deletion(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted((f"v{rng.randrange(40)}", f"v{rng.randrange(40)}"))) for _ in range(45)})
    edges = [(a, b) for a, b in edges if a != b]

    def parts(without):
        near = {}
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, set()).add(y)
        seen, n = set(), 0
        for s in near:
            if s in seen or s == without:
                continue
            n, todo = n + 1, [s]
            while todo:
                x = todo.pop()
                if x not in seen and x != without:
                    seen.add(x)
                    todo += near[x]
        return n

    nodes = {x for e in edges for x in e}
    want = sorted((x,) for x in nodes if parts(x) > parts(None))
    assert rows(graph.cut_vertices(spark.createDataFrame(edges, "source string, target string"))) == want


def test_components_of_a_long_chain_and_numbers_in_order(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("a", "z"), ("q", "q")]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "u string, v string"), "u", "v")))
    assert got["n060"] == "n000" and got["z"] == "a" and got["q"] == "q" and len(set(got.values())) == 3
    hits = spark.createDataFrame([("b", "a"), ("d", "c"), ("e", "a")], "query string, target string")
    assert rows(graph.clusters(hits)) == [("a", "CHG_1"), ("b", "CHG_1"), ("c", "CHG_2"), ("d", "CHG_2"), ("e", "CHG_1")]


def test_communities_stay_in_components_and_raise_modularity(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 200.0) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 150.0), ("x", "y", 300.0), ("p", "q", 50.0)]
    hits = spark.createDataFrame(edges, "query string, target string, bits double")
    got = dict(rows(graph.communities(hits)))
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"] and got["x"] == got["y"] and "p" not in got
    with pytest.raises(ValueError):
        graph.communities(hits, 1000.0)


def test_twins_ignore_weights_and_number_by_cluster_number(spark):
    adj = spark.createDataFrame([("g1", "CHG_10", 1), ("g2", "CHG_10", 5), ("g1", "CHG_2", 3), ("g2", "CHG_2", 1), ("g1", "CHG_9", 1), ("g3", "CHG_9", 1), ("g1", "CHG_11", 1), ("g3", "CHG_11", 2), ("g3", "CHG_4", 1), ("g2", "CHG_4", 1)], "genome string, chg string, weight int")
    assert dict(rows(graph.twins(adj))) == {"CHG_10": "CHG_TWIN_1", "CHG_2": "CHG_TWIN_1", "CHG_9": "CHG_TWIN_2", "CHG_11": "CHG_TWIN_2", "CHG_4": "CHG_4"}


def test_best_hits_ties_directions_and_unmapped_clusters(spark):
    hits = spark.createDataFrame([("p1", "q1", 90.0), ("p2", "q2", 90.0), ("q3", "p3", 95.0), ("p4", "q4", 80.0)], "query string, target string, pident double")
    proteins = spark.createDataFrame([(f"{x}{i}", f"g{x}") for x in "pq" for i in (1, 2, 3, 4)], "protein_id string, genome_accession string")
    taxids = spark.createDataFrame([("gp", "10"), ("gq", "2")], "genome_accession string, taxid string")
    members = spark.createDataFrame([(f"{x}{i}", "C") for x in "pq" for i in (1, 2, 3)], "protein_id string, chg_id string")
    distances = spark.createDataFrame([("gq", "gp", 4)], "genome_a string, genome_b string, N_int int")
    ann = ranking.annotate(hits, proteins, taxids, members, distances)
    assert ann.count() == 4 and {r["n_int"] for r in ann.collect()} == {4}
    best = {(r["chg"], r["tax_a"], r["tax_b"]): (r["prot_a"], r["similarity"]) for r in ranking.best_hits(ann, True).collect()}
    assert best == {("C", "10", "2"): ("p1", 90.0), ("C", "2", "10"): ("q3", 95.0), (None, "10", "2"): ("p4", 80.0)}
    assert ranking.symmetrize(ranking.best_hits(ann, True)).count() == 4
    pair = {r["chg"]: r["prot_a"] for r in ranking.best_hits(ann, False).collect()}
    assert pair == {"C": "q3", None: "p4"}
    scores = ranking.score_hits(hits, proteins, taxids, members, distances, ranking.ScoringParams()).collect()
    assert {(r["CHG"], r["TaxID_A"]): r["HGT_score"] for r in scores} == {("C", "10"): 450.0, ("C", "2"): 475.0, (None, "10"): 400.0, (None, "2"): 400.0}


def test_threshold_rank_keeps_a_gap_equal_to_the_threshold(spark):
    adj = spark.createDataFrame([("c", "t", n, s) for n, s in (("a", 90.0), ("b", 89.5), ("c", 89.0), ("d", 88.0))], "chg string, tax string, neighbor string, sim double")
    assert [r["rank"] for r in ranking.threshold_ranks(adj, 0.5).orderBy("neighbor").collect()] == [1, 1, 1, 2]


def test_stats_by_distance_of_single_and_constant_samples(spark):
    best = spark.createDataFrame([(1, 90.0), (2, 80.0), (2, 80.0), (3, 70.0), (3, 72.0), (0, 5.0)], "n_int int, similarity double")
    got = {r["n_int"]: (r["mu"], r["sigma"]) for r in ranking.stats_by_distance(best).collect()}
    assert got[1] == (90.0, 1.0) and got[2] == (80.0, 1.0) and got[3] == (71.0, pytest.approx(2**0.5)) and 0 not in got


def test_unknown_method():
    with pytest.raises(ValueError):
        scorer("none")
    assert scorer(ScoringMethod.ZSCORE)


def test_newick_unary_nodes_quotes_and_distances(spark):
    nodes = spark.createDataFrame(tree.parse_newick("((A:1,B:2)x:1,((C:1)):3,'D d':1);"), "node_id int, parent_id int, name string, length double, depth int, path array<int>")
    got = {(r["genome_a"], r["genome_b"]): r["N_int"] for r in tree.leaf_distances(nodes).collect()}
    assert got == {("A", "B"): 1, ("A", "C"): 4, ("B", "C"): 4, ("A", "D d"): 2, ("B", "D d"): 2, ("C", "D d"): 3}
    with pytest.raises(ValueError):
        tree.parse_newick("((A,B);")


def test_distances_of_a_random_tree(spark):
    rng, parent = random.Random(9), {1: 0}
    for i in range(2, 60):
        parent[i] = rng.randrange(i)
    inner = set(parent.values())
    rows_ = [(str(i), None if i == 0 else str(parent[i]), "" if i in inner else f"L{i}") for i in range(60)]
    nodes = spark.createDataFrame(tree.parse_newick(tree.to_newick(rows_)), "node_id int, parent_id int, name string, length double, depth int, path array<int>")

    def up(i):
        return [i] + (up(parent[i]) if i else [])

    def between(i, j):
        a, b = up(i), up(j)
        meet = next(x for x in a if x in b)
        return a.index(meet) + b.index(meet) - 1

    ends = [i for i in range(60) if i not in inner]
    want = {frozenset((f"L{i}", f"L{j}")): between(i, j) for i in ends for j in ends if i < j}
    d = tree.leaf_distances(nodes)
    assert {frozenset((r["genome_a"], r["genome_b"])): r["N_int"] for r in d.collect()} == want
    r = tree.distance_summary(d, nodes).first()
    assert r["n_int_mean"] == pytest.approx(sum(want.values()) / len(want)) and r["leaf_count"] == len(ends)
    m = tree.mean_distance(nodes).first()
    assert m["n_int_mean"] == pytest.approx(r["n_int_mean"]) and m["leaf_count"] == len(ends)
    some = d.where("N_int > 3").select("genome_b", "genome_a")
    assert rows(tree.pair_distances(nodes, some)) == sorted((r["genome_a"], r["genome_b"], r["N_int"]) for r in d.collect() if r["N_int"] > 3)
    assert tree.mean_distance(nodes.where("false")).first()["n_int_mean"] == 0.0


def test_rename_leaves_longest_first():
    assert tree.rename_leaves("(E.c:1,E.c2:2,xE.c:3);", {"E.c": "NC_E_c", "E.c2": "NC_E_c2"}) == "(NC_E_c:1,NC_E_c2:2,xE.c:3);"


def test_lineage_newick():
    assert tree.to_newick([("R", None, "Root"), ("R|a", "R", "a"), ("R|a|x", "R|a", "x 1")]) == "(('x 1':1)a:1)Root;"


def _naive_alignment(a, b):
    table = [list(map(int, r.split())) for r in similarity.BLOSUM62.strip().splitlines()]
    at = similarity.RESIDUES.index
    n, m, low = len(a), len(b), -(10**6)
    h, e, f = ([[z] * (m + 1) for _ in range(n + 1)] for z in (0, low, low))
    best = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i - 1][j] - 12, e[i - 1][j] - 1)
            f[i][j] = max(h[i][j - 1] - 12, f[i][j - 1] - 1)
            h[i][j] = max(0, h[i - 1][j - 1] + table[at(a[i - 1])][at(b[j - 1])], e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_alignment_scores_match_the_textbook():
    rng = random.Random(5)
    pairs = []
    for _ in range(30):
        a = "".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(rng.randint(1, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 3)] = rng.choice(["", "A", "WW", "KLM"])
        pairs.append((a, "".join(b) or "A"))
    got = similarity.local_alignments(pairs)
    assert [int(x) for x in got[:, 0]] == [_naive_alignment(a, b) for a, b in pairs]
    assert similarity.local_alignments([("ACDEFGHIKL", "ACDEFGHIKL")])[0].tolist()[1:] == [10, 10, 0, 10, 0, 10]


def test_descriptive_statistics_and_bootstrap(spark):
    import numpy as np

    x = np.random.default_rng(1).gamma(2.0, 3.0, 400)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "HGT_score double")
    r = stats.describe(df).first()
    assert r["count"] == 400 and r["median"] == pytest.approx(np.median(x)) and r["q95"] == pytest.approx(np.percentile(x, 95)) and r["std"] == pytest.approx(x.std())
    b = stats.bootstrap_quantiles(spark, df, (0.95,), 300).first()
    assert b["lower"] <= b["point"] <= b["upper"] and b["point"] == pytest.approx(np.percentile(x, 95))
    assert stats.bootstrap_quantiles(spark, df, (0.95,), 300).first() == b
    fits = {r["name"]: r for r in stats.fit_distributions(df).collect()}
    assert set(fits) == {"normal", "lognormal", "exponential", "gamma"} and min(fits, key=lambda k: fits[k]["ks"]) == "gamma"
    assert fits["gamma"]["params"][0] == pytest.approx(2.0, rel=0.2) and fits["gamma"]["p_value"] > 0.05
    assert stats.describe(df.where("false")).first()["count"] == 0 and stats.fit_distributions(df.where("false")).count() == 0


def test_inputfile_fasta_and_genbank(spark, tmp_path):
    p = tmp_path / "inputfile"
    p.write_text("3 4\nE.coli  ACDE\n\nB.sub x FGHI\nonly\nE.coli KLMN\n")
    got = files.read_inputfile(spark, str(p))
    assert rows(got.select("name", "sequence")) == [("B.sub", "FGHI"), ("E.coli", "ACDE"), ("E.coli", "KLMN")]
    assert rows(files.name_map(got).select("genome_accession", "sequence")) == [("NC_B_sub", "FGHI"), ("NC_E_coli", "KLMN")]
    (tmp_path / "bacteria").mkdir()
    (tmp_path / "bacteria" / "NC_1_proteins.faa").write_text(">p1 heat shock\nAC\nDE\n>p2\nFG\n")
    f = files.read_protein_folders(spark, {"bacteria": str(tmp_path / "bacteria"), "virus": str(tmp_path / "none")})
    assert rows(f.select("protein_id", "sequence")) == [("bacteria_NC_1_p1_heat_shock_1", "ACDE"), ("bacteria_NC_1_p2_hypothetical_protein_2", "FG")]
    gb = tmp_path / "x.gb"
    gb.write_text(
        "LOCUS       X1\nDEFINITION  a thing\nACCESSION   X1\nVERSION     X1.2\nDBLINK      BioProject: PRJNA5\n            BioSample: SAMN7\nSOURCE      s\n  ORGANISM  Bug one\n            Bacteria; Phylota;\n            Class.\nFEATURES             Location/Qualifiers\n"
        '     source          1..18\n                     /db_xref="taxon:77"\n                     /host="man"\n     CDS             complement(1..9)\n                     /product="long\n                     name"\n     CDS             join(1..3,7..9)\n                     /protein_id="P9"\n                     /translation="MK\n                     LV"\nORIGIN\n        1 atgaaatag ggccccat\n//\n'
    )
    r = files.read_genbank(spark, str(gb))
    assert rows(files.genbank_proteins(r).select("protein_id", "product", "sequence")) == [("P9", "hypothetical protein", "MKLV"), ("unknown", "long name", "LFH")]
    assert {x["type"] for x in files.genbank_genes(r).collect()} == {"CDS"}
    m = files.genbank_metadata(r, "bacteria").first().asDict()
    assert m["TaxID"] == "77" and m["BioProject ID"] == "5" and m["BioSample Accession"] == "SAMN7" and m["Phylum"] == "Phylota" and m["Host"] == "man"


def test_guard_without_optional_parts():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['kinweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'sco_07_ranking_th' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=100).returncode == 0


def test_whole_analysis_of_a_made_dataset(spark, tmp_path):
    from kinweave.plans.pipeline import Analysis, transfers

    rng, n = random.Random(4), 12
    base = "".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(90))

    def changed(share):
        return "".join(rng.choice("ARNDCQEGHILKMFPSTWYV") if rng.random() < share else c for c in base)

    (tmp_path / "00_input").mkdir()
    (tmp_path / "00_input" / "inputfile").write_text(f"{n} 90\n" + "".join(f"Org.{i} {changed(0.02 * i)}\n" for i in range(n)))
    text = "Org.0"
    for i in range(1, n):
        text = f"({text}:1,Org.{i}:1)"
    (tmp_path / "00_input" / "tree.newick").write_text(text + ";\n")
    a = Analysis(spark, str(tmp_path), replicates=200)
    out = a.run()
    assert out["distances"].count() == n * (n - 1) // 2
    hits = out["hits"].collect()
    assert hits and all(59 <= h["pident"] <= 100 and h["query"] != h["target"] for h in hits)
    scores = out["scores"].collect()
    assert len({(r["TaxID_A"], r["TaxID_B"]) for r in scores}) == len(scores) and scores == sorted(scores, key=lambda r: -r["HGT_score"])
    text = a.report(out)
    assert "CANDIDATES" in text and "Alignment" in text
    _, proteins, _ = a.prepare()
    t = transfers(out["hits"], proteins, out["membership"], out["scores"], 100)
    assert t["best"].count() >= 0 and t["genome_hits"].count() == len(hits)


def test_hits_above_bootstrap_bounds_by_brute_force(spark, monkeypatch):
    from types import SimpleNamespace

    import numpy as np

    from kinweave.operators import lgt, stats
    from kinweave.plans import queries

    rng, values = np.random.default_rng(5), {}
    for pair, taxa in enumerate((("A", "B"), ("A", "C"))):
        values["-".join(taxa)] = [*np.round(rng.uniform(40, 60 + 10 * pair, 80), 2).tolist(), 98.0]
    hits, proteins, membership = [], [], []
    for pair, own in values.items():
        for k, v in enumerate(own):
            ids = [f"{pair}{k}{side}" for side in "qt"]
            hits.append((*ids, v, 100, 0.0, 2 * v)), membership.append((ids[0], f"CHG_{k}"))
            proteins.extend((i, f"G{taxon}", taxon) for i, taxon in zip(ids, pair.split("-"), strict=True))
    star = SimpleNamespace(
        hits=spark.createDataFrame(hits, "query string, target string, pident double, alnlen int, evalue double, bits double"),
        proteins=spark.createDataFrame(proteins, "protein_id string, genome_accession string, taxon string"),
        membership=spark.createDataFrame(membership, "protein_id string, chg_id string"),
    )
    marked = queries._bootstrapped(star).collect()
    assert len(marked) == sum(map(len, values.values()))
    for pair, own in values.items():
        q = [np.percentile(rng.choice(own, len(own)), 95) for _ in range(10_000)]
        got = [r for r in marked if r["taxon_pair"] == pair]
        bound = got[0]["q95_upper_bound"]
        assert abs(bound - np.percentile(q, 97.5)) < 1.0
        assert {r["pident"] for r in got if r["is_significant"]} == {v for v in own if v > bound} >= {98.0}
        assert sum(r["is_significant"] for r in got) < 0.05 * len(own)
    asked = []
    for name in ("bootstrap_quantiles", "grouped_bootstrap"):
        default = getattr(stats, name).__defaults__
        assert 10_000 in default
        monkeypatch.setattr(stats, name, lambda *a, **k: asked.append((a[3:], k)))
    data = "/root/testdata/sf0.001"
    queries.queries()["sta_02_bootstrap_quantile"](spark, data), queries.queries()["sta_03_grouped_bootstrap"](spark, data)
    assert all(not a and k.get("replicates", 10_000) == 10_000 for a, k in asked) and len(asked) == 2
    assert lgt.breakdown(spark.createDataFrame(marked)).count() == 2


def test_one_decimal_of_all_hits_and_of_ties(spark):
    from pyspark.sql import functions as F

    from kinweave.functions import scalars as S
    from kinweave.plans import queries
    from kinweave.plans.adapters import Star

    data = "/root/testdata/sf0.001"
    out = queries.queries()["prj_13_one_decimal_all"](spark, data)
    assert out.count() == Star(spark, data).hits.count() and out.where("s_ab <> round(s_ab)").count() > 0
    given = {98.25: 98.2, 98.75: 98.8, 99.05: 99.0, 97.15: 97.2, 99.96: 100.0, 98.333333: 98.3, 97.0: 97.0}
    d = spark.createDataFrame([(x,) for x in given], "x double").select("x", S.one_decimal(F.col("x")).alias("y"))
    assert {r["x"]: r["y"] for r in d.collect()} == given


def test_scores_by_few_keys_are_not_shuffled_by_them(spark):
    """Statistics of two distances are sent to all tasks; ranks and reverse hits need no join."""
    from kinweave.operators import joins, ranking
    from kinweave.functions.scorers import ScoringMethod

    rows = [("c", f"{k % 3}", f"{3 + k % 4}", f"p{k}", f"q{k}", "g", "h", 3 + 2 * (k % 2), 90.0 + k) for k in range(40)] + [(None, "1", "2", "p", "q", "g", "h", 3, 95.0)]
    best = spark.createDataFrame(rows, "chg string, tax_a string, tax_b string, prot_a string, prot_b string, genome_a string, genome_b string, n_int int, similarity double")
    plan = ranking.scored(best, ranking.ScoringParams(method=ScoringMethod.MODIFIED))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    hits = spark.createDataFrame([("a", "b", 90.0), ("b", "a", 95.0), ("a", "c", 90.0)], "query string, target string, pident double").selectExpr("'c' chg", "query tax_a", "target tax_b", "query", "target", "query genome_a", "target genome_b", "3 n_int", "pident")
    both = ranking.symmetric_best(hits)
    assert sorted(map(tuple, both.drop("_lo", "_hi").collect())) == sorted(map(tuple, ranking.symmetrize(ranking.best_hits(hits, True)).collect()))
    adj = ranking.adjacency(both)
    for threshold, ranks in ((None, ranking.simple_ranks(adj)), (0.5, ranking.threshold_ranks(adj, 0.5))):
        found = ranking.with_ranks(both, threshold)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r["tax_a"], r["tax_b"], r["rank"]) for r in found.collect()) == sorted((r["tax"], r["neighbor"], r["rank"]) for r in ranks.collect())
    table = spark.range(10).selectExpr("id k", "id v")
    before, joins.SMALL_ROWS = joins.SMALL_ROWS, 5
    try:
        large = joins.join_lookup(spark.range(30).selectExpr("id % 12 k"), table, "k", "left")
        assert large.count() == 30 and large.where("v is null").count() == 4
    finally:
        joins.SMALL_ROWS = before


def test_best_transfers_are_computed_once(spark):
    """Bounds and marks read the written best hits, and neither hits nor items again."""
    from kinweave.plans import queries
    from kinweave.plans.adapters import Star

    files = queries._marked(Star(spark, "/root/testdata/sf0.001")).inputFiles()
    assert files and all("kinweave-best-" in f or "kinweave-lookup-" in f for f in files)
