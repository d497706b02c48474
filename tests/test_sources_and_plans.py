"""Files, workbooks, the fetcher, stages, the seven methods in an analysis, statistics by rank."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from kinweave.functions.scorers import ScoringMethod
from kinweave.operators import ranking, similarity, stats, tree
from kinweave.operators.sets import DisjointSets
from kinweave.sources import fetch, files, sinks
from kinweave.sources.remote import RecordedClient, retry


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fasta_across_splits_equals_one_read(spark, tmp_path):
    rng = random.Random(3)
    records = [(f"p{i}", "".join(rng.choice("ACDE") for _ in range(rng.randint(0, 90)))) for i in range(400)]
    text = "junk before\n" + "".join(f">{n} some words {k}\r\n{s[:40]}\n{s[40:]}\n" for k, (n, s) in enumerate(records))
    (tmp_path / "a.faa").write_text(text)
    (tmp_path / "b.faa").write_text(">only\nAC\n\nDE")
    (tmp_path / "c.faa").write_text("no fasta\n")
    (tmp_path / "d.faa").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        got = {(r["file"].rpartition("/")[2], r["record"]): (r["id"], r["sequence"]) for r in files.read_fasta(spark, str(tmp_path), "*.faa").collect()}
        counts = dict(rows(files.count_sequences(spark, str(tmp_path))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {**{("a.faa", k + 1): r for k, r in enumerate(records)}, ("b.faa", 1): ("only", "ACDE")}
    assert counts == {"a.faa": -1, "b.faa": 1, "c.faa": -1, "d.faa": 0}


def test_last_rows_and_headers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("protein_id,genome_accession,taxon\np1,g1,Virus\np2,g1,Bacteria\np1,g2,Archaea\n")
    (tmp_path / "q.csv").write_text("p1,g1,Virus\np2,g1,BACTERIA\n")
    (tmp_path / "m.tsv").write_text("p1\tC1\np2\tC2\np1\tC3\n")
    (tmp_path / "r.tsv").write_text("protein_id\tchg_id\toriginal_chg_id\np1\tT1\tC1\n")
    (tmp_path / "t.csv").write_text("genome_accession,organism_name,taxid\ng1,a,1\ng1,b,2\ng2,c\n")
    (tmp_path / "d.tsv").write_text("genome_a\tgenome_b\tN_int\nx\ty\t9\ny\tx\t4\nx\tz\t1\n")
    at = lambda n: str(tmp_path / n)
    assert rows(files.read_proteins(spark, at("p.csv"))) == [("p1", "g2", "Archaea"), ("p2", "g1", "Bacteria")]
    assert rows(files.read_proteins(spark, at("q.csv"))) == [("p1", "g1", "Virus"), ("p2", "g1", "BACTERIA")]
    assert rows(files.read_taxon_of_genome(spark, at("p.csv"))) == [("g1", "bacteria"), ("g2", "archaea")]
    assert rows(files.read_membership(spark, at("m.tsv"))) == [("p1", "C3"), ("p2", "C2")]
    assert rows(files.read_membership(spark, at("r.tsv"))) == [("p1", "T1")]
    assert rows(files.read_taxids(spark, at("t.csv"))) == [("g1", "b", "2")]
    assert rows(files.read_distances(spark, at("d.tsv"))) == [("x", "y", 4), ("x", "z", 1)]


def test_workbooks_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("U1", "Bug & <one>", "NC_1,NC_2", "7.0", None), ("U2", "Bug two", "-", "8", "x")], "UniqID string, `Organism/Name` string, `Chromosomes/RefSeq` string, Genes string, Other string")
    path = str(tmp_path / "list.xlsx")
    sinks.write_workbook(d, path)
    back = files.read_workbook(spark, path)
    assert back.columns == d.columns and rows(back) == rows(d)
    got = files.read_organisms(spark, path, "bacteria").collect()
    assert [(r["uniq_id"], r["organism"], r["accessions"], r["additional"]["_expected_genes"]) for r in got] == [("U1", "Bug & <one>", ["NC_1", "NC_2"], "7")]
    assert files.read_organisms(spark, str(tmp_path / "none.xlsx"), "virus").count() == 0


def flat(name, organism="Bug", bases="atgaaatag"):
    gap = " " * 21
    return f'LOCUS       {name}\nDEFINITION  thing\nACCESSION   {name}\nVERSION     {name}\nSOURCE      s\n  ORGANISM  {organism}\n            Bacteria; Phylota.\nFEATURES             Location/Qualifiers\n     source          1..9\n{gap}/db_xref="taxon:7"\n     CDS             1..9\n{gap}/protein_id="P_{name}"\nORIGIN\n        1 {bases}\n//\n'


def test_fetching_resolves_caches_and_counts(spark, tmp_path):
    recorded = [("gb", n, flat(n)) for n in ("NC_1", "NC_2", "NC_3", "NC_9")] + [("gb", "NC_bad", "not a record"), ("gb", "alias", flat("NC_1"))]
    records = spark.createDataFrame(
        [(1, "U1", "Bug", "7", "bacteria", ["NC_1"], {"_expected_genes": "1"}), (2, "U2", "Bug", None, "bacteria", ["NC_2", "NC_3"], {"_expected_genes": "9"}), (3, "U3", "Worm", None, "bacteria", ["PRJ5"], {}), (4, "U4", "None", None, "bacteria", ["PRJ6"], {}),
         (5, "U5", "Dup", None, "bacteria", ["alias"], {}), (6, "U6", "Bad", None, "bacteria", ["NC_bad"], {}), (7, "U7", "Missing", None, "bacteria", ["NC_7"], {})],
        "line int, uniq_id string, organism string, taxid string, category string, accessions array<string>, additional map<string,string>",
    )
    terms = {(r["uniq_id"], r["query_rank"]): r["term"] for r in fetch.search_terms(records).collect()}
    assert len(terms) == 14 and terms["U3", 2] == "(PRJ5[BioProject] OR PRJ5[BioProject ID])" and terms["U3", 6] == '"Worm"[Organism]'
    recorded += [("search", terms["U3", 6], "NC_9"), ("search", terms["U3", 5], "NC_9")]
    client = RecordedClient(spark.createDataFrame(recorded, "kind string, key string, body string"))
    config = fetch.DatasetConfig.preset("bacteria")
    fetcher = fetch.Fetcher(client, str(tmp_path / "raw"))
    got = {r["uniq_id"]: r for r in fetcher.fetch_dataset(records, config).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"U1": "success", "U2": "success", "U3": "success", "U4": "failed", "U5": "duplicate", "U6": "failed", "U7": "failed"}
    assert got["U4"]["error"] == "Could not resolve BioProject PRJ6" and got["U5"]["error"] == "Already fetched as U1" and got["U2"]["sequence_length"] == 18
    assert got["U1"]["ok"] is True and got["U2"]["ok"] is False and got["U3"]["ok"] is None
    again = fetcher.fetch_dataset(records, config)
    assert {r["uniq_id"]: r["status"] for r in again.collect()} == {"U1": "cached", "U2": "cached", "U3": "cached", "U4": "failed", "U5": "duplicate", "U6": "failed", "U7": "failed"}
    c = fetch.counters(again).first()
    assert (c["total"], c["succeeded"], c["cached"], c["duplicates"], c["failed"]) == (7, 3, 3, 1, 3)
    assert fetch.Fetcher(client, str(tmp_path / "raw2"), use_cache=False).fetch_dataset(records, config, 2).count() == 2
    assert rows(spark.read.parquet(str(tmp_path / "raw" / "proteins" / "bacteria")).select("protein_id", "sequence")) == [(f"P_NC_{k}", "MK") for k in (1, 2, 3, 9)]
    made = fetch.result_rows(again).where("UniqID = 'U1'").first()
    assert made["Organism/Name"] == "Bug" and made["_status"] == "cached" and made["_fasta_file"] is None
    every = fetch.fetch_all(fetch.Fetcher(client, str(tmp_path / "raw3")), {"virus": records.where("line in (1, 4)"), "plasmid": records.where("line = 7")})
    assert {r["category"]: (r["total"], r["succeeded"]) for r in every.collect()} == {"virus": (2, 1), "plasmid": (1, 0)}


def test_retry_waits_longer_and_gives_up():
    waits, calls = [], []

    @retry(attempts=3, sleep=waits.append)
    def fails():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        fails()
    assert waits == [2.0, 4.0] and len(calls) == 3

    @retry(sleep=waits.append)
    def wrong():
        raise KeyError("other")

    with pytest.raises(KeyError):
        wrong()


def test_disjoint_sets(spark):
    s = DisjointSets.of(spark.createDataFrame([("a", "b"), ("c", "d")], "u string, v string"), "u", "v")
    t = s.union(spark.createDataFrame([("d", "b"), ("x", "y")], "u string, v string"), "u", "v")
    nodes = spark.createDataFrame([("d",), ("y",), ("lone",)], "node string")
    assert rows(t.find(nodes)) == [("d", "a"), ("lone", "lone"), ("y", "x")] and rows(s.find(nodes))[0] == ("d", "c")
    assert {r["component"]: r["members"] for r in t.members().collect()} == {"a": ["a", "b", "c", "d"], "x": ["x", "y"]}


def made_dataset(folder: Path, n: int = 12) -> None:
    rng = random.Random(4)
    base = "".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(90))
    changed = lambda share: "".join(rng.choice("ARNDCQEGHILKMFPSTWYV") if rng.random() < share else c for c in base)
    (folder / "00_input").mkdir(parents=True)
    (folder / "00_input" / "inputfile").write_text(f"{n} 90\n" + "".join(f"Org.{i} {changed(0.02 * i)}\n" for i in range(n)))
    text = "Org.0"
    for i in range(1, n):
        text = f"({text}:1,Org.{i}:1)"
    (folder / "00_input" / "tree.newick").write_text(text + ";\n")


def test_all_methods_score_in_an_analysis_and_stages_agree(spark, tmp_path):
    from kinweave.plans import stages
    from kinweave.plans.pipeline import Analysis, run_transfers

    made_dataset(tmp_path / "d")
    a = Analysis(spark, str(tmp_path / "d"), replicates=200)
    out = a.run()
    assert a.scoring.n_int_mean > 0 and 59 <= a.scoring.hits_mean <= 100
    inputs = out["hits"], out["proteins"], out["taxids"], out["reduced_membership"].select("protein_id", "chg_id"), out["distances"]
    for method in ScoringMethod:
        params = ranking.ScoringParams(method=method, n_int_mean=a.scoring.n_int_mean, hits_mean=a.scoring.hits_mean)
        scores = [r["HGT_score"] for r in ranking.score_hits(*inputs, params).collect()]
        assert scores and any(abs(x) > 1e-9 for x in scores), method
    text = (tmp_path / "d" / "05_phylogeny" / "phylogeny_stats")
    assert spark.read.json(str(text)).first()["n_int_mean"] == pytest.approx(a.scoring.n_int_mean)
    # the stages after the alignment, from the files that the analysis wrote
    data = str(tmp_path / "d")
    assert rows(stages.clusters(spark, data)) == rows(out["membership"])
    assert rows(stages.network(spark, data)) == rows(out["nodes"])
    stages.reduce(spark, data)
    assert {r["node_id"] for r in spark.read.csv(f"{data}/04_networks/genome_nodes", header=True).collect()} <= {r["genome_accession"] for r in out["proteins"].collect()}
    want = {(r["protein_A"], r["protein_B"]): round(r["HGT_score"], 6) for r in out["scores"].collect()}
    got = {(r["protein_A"], r["protein_B"]): round(r["HGT_score"], 6) for r in stages.score(spark, data, ScoringMethod.RANKING_TH, 100).collect()}
    assert got == want
    t = run_transfers(spark, data, 100)
    place = [tuple(r) for r in t["best"].select("chg", "taxon_pair", "query").collect()]
    assert place == sorted(place) and t["genome_hits"].count() == out["hits"].count()
    a.close()
    assert stages.main(["score", str(tmp_path / "nowhere")]) == 1


def test_species_tree_of_lineages(spark, tmp_path):
    bodies = {"A1": ("1", "Bug a", "cell; Bacteria"), "A2": ("2", "Bug b", "cell; Bacteria"), "A3": ("3", "Worm", "cell; Animal")}
    recorded = [("taxonomy", k, f'{{"taxid":"{t}","name":"{n}","rank":"species","lineage":"{x}"}}') for k, (t, n, x) in bodies.items()]
    taxonomy = RecordedClient(spark.createDataFrame(recorded, "kind string, key string, body string")).taxonomy(spark.createDataFrame([(k,) for k in [*bodies, "A9"]], "accession string"))
    out = tree.write_species_tree(taxonomy, str(tmp_path))
    assert rows(out["organisms"]) == [("A1", "Bug a", "1"), ("A2", "Bug b", "2"), ("A3", "Worm", "3")]
    nodes = tree.read_newick(spark, f"{tmp_path}/reduced_species_tree")
    assert {(r["genome_a"], r["genome_b"]): r["N_int"] for r in tree.leaf_distances(nodes).collect()} == {("A1", "A2"): 3, ("A1", "A3"): 5, ("A2", "A3"): 5} or tree.leaves(nodes).count() == 3
    assert out["counts"].first()["leaves"] == 3


def test_bootstrap_by_rank_is_the_bootstrap(spark):
    """Bounds against plain resamples of the same values, with ties, and for groups of very unequal size."""
    rng = np.random.default_rng(2)
    x = np.round(rng.gamma(2.0, 3.0, 700), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "HGT_score double")
    for q in (0.5, 0.95, 0.99):
        plain = np.array([np.percentile(rng.choice(x, len(x)), 100 * q) for _ in range(4000)])
        got = stats.bootstrap_quantiles(spark, df, (q,), 4000).first()
        spread = plain.std()
        assert got["point"] == pytest.approx(np.percentile(x, 100 * q))
        assert abs(got["lower"] - np.percentile(plain, 2.5)) < 0.5 * spread + 0.1 and abs(got["upper"] - np.percentile(plain, 97.5)) < 0.5 * spread + 0.1
    groups = {"big": rng.normal(80, 5, 3000), "one": np.array([7.0]), "two": np.array([1.0, 9.0])}
    d = spark.createDataFrame([(g, float(v)) for g, own in groups.items() for v in own], "taxon_pair string, pident double")
    got = {r["taxon_pair"]: r for r in stats.grouped_bootstrap(d, replicates=2000).collect()}
    assert got["one"]["q95_lower_bound"] == got["one"]["q95_upper_bound"] == 7.0 and 1.0 <= got["two"]["q95_lower_bound"] <= got["two"]["q95_upper_bound"] == 9.0
    plain = np.array([np.percentile(rng.choice(groups["big"], 3000), 95) for _ in range(2000)])
    assert abs(got["big"]["q95_upper_bound"] - np.percentile(plain, 97.5)) < 0.5 * plain.std()
    assert rows(stats.grouped_bootstrap(d, replicates=2000)) == rows(stats.grouped_bootstrap(d.repartition(7), replicates=2000))


def test_distribution_functions_of_arrays():
    import math

    x = np.array([-2.0, -0.5, 0.0, 0.3, 1.0, 4.0, 30.0])
    assert stats.distribution_cdf("normal", (0.5, 2.0), x) == pytest.approx([0.5 * (1 + math.erf((v - 0.5) / (2 * math.sqrt(2)))) for v in x], abs=1e-12)
    assert stats.distribution_cdf("gamma", (1.0, 0.0, 2.0), x) == pytest.approx([1 - math.exp(-max(0, v) / 2) for v in x], abs=1e-12)
    assert stats.distribution_cdf("gamma", (3.0, 0.0, 1.0), x) == pytest.approx([1 - math.exp(-max(0, v)) * (1 + max(0, v) + max(0, v) ** 2 / 2) for v in x], abs=1e-12)
    assert stats.distribution_cdf("lognormal", (0.7, 1.5), x)[3:] == pytest.approx([0.5 * (1 + math.erf(math.log(v / 1.5) / (0.7 * math.sqrt(2)))) for v in x[3:]], abs=1e-12)


def test_plot_data(spark):
    rng = np.random.default_rng(8)
    x = np.append(rng.normal(10, 2, 500), [40.0, -30.0])
    df = spark.createDataFrame([(float(v),) for v in x], "HGT_score double")
    b = stats.box_data(df).first()
    low, high = np.percentile(x, [25, 75])
    assert b["outliers"] >= 2 and b["whisker_high"] == max(v for v in x if v <= high + 1.5 * (high - low))
    v = stats.violin_data(df, 50).toPandas()
    assert len(v) == 50 and np.trapezoid(v["density"], v["at"]) == pytest.approx(1, abs=0.05)
    fits = stats.fit_distributions(df)
    assert stats.theoretical_curves(fits, 0.0, 20.0, 11).count() == 11 * fits.count()
    assert stats.box_data(df.where("false")).count() == 0 and stats.violin_data(df.where("false")).count() == 0
    assert stats.bootstrap_curve(spark, df).count() == 4


@pytest.mark.parametrize("identity", ["exact", "estimated"])
def test_search_finds_what_full_alignment_finds(spark, identity):
    """Recall of the k-mer candidates against the alignment of all pairs, and the three ways of coverage."""
    rng = random.Random(6)
    residues = "ARNDCQEGHILKMFPSTWYV"
    made = []
    for family in range(8):
        base = "".join(rng.choice(residues) for _ in range(60))
        made += [(f"f{family}_{k}", "".join(rng.choice(residues) if rng.random() < 0.12 * k else c for c in base)) for k in range(5)]
    seqs = spark.createDataFrame(made, "name string, sequence string")
    found = {mode: {tuple(sorted((r["query"], r["target"]))) for r in similarity.align(seqs, similarity.SearchParams(min_identity=0.3, coverage_mode=mode, identity=identity)).collect()} for mode in (0, 1, 2)}
    every = similarity.align(seqs, similarity.SearchParams(min_identity=0.3, seeds="kmer", kmer=1, identity=identity))
    want = {tuple(sorted((r["query"], r["target"]))) for r in every.collect()}
    assert found[0] <= want and len(found[0]) >= 0.9 * len(want) and found[0] <= found[1] and found[0] <= found[2]


def test_public_names():
    import importlib

    for package in ("kinweave", "kinweave.operators", "kinweave.functions", "kinweave.sources", "kinweave.plans"):
        m = importlib.import_module(package)
        assert m.__all__ and all(getattr(m, n) is not None for n in m.__all__)
        with pytest.raises(AttributeError):
            m.no_such_name  # noqa: B018
