"""The stages of the analysis one at a time, each from the files of those before it.

    python -m kinweave.plans.stages preprocess DATASET

A stage reads its inputs from the dataset folder and writes its outputs there, so it
can be run again on its own, or on files that came from elsewhere.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scorers import ScoringMethod
from ..operators import graph, ranking, similarity, stats, tree
from ..runtime import materialize, session
from ..sources import fetch, files, sinks
from ..sources.remote import ArchiveClient, RecordedClient
from .pipeline import restore_names, run_transfers

CATEGORIES = ("archaea", "bacteria", "plasmid", "virus")


def recorded_client(spark: SparkSession, dataset: str) -> ArchiveClient:
    """The responses recorded under ``00_input/recorded``: Parquet of (kind, key, body)."""
    return RecordedClient(spark.read.parquet(f"{dataset}/00_input/recorded"))


def fetch_stage(spark: SparkSession, dataset: str, client: ArchiveClient | None = None) -> DataFrame:
    """Records of each category's list (``00_input/CATEGORY.xlsx`` or ``.csv``) to ``01_raw_genomes``; counters by category."""
    client = client or recorded_client(spark, dataset)
    lists = {}
    for name in CATEGORIES:
        own = [files.read_organisms(spark, f"{dataset}/00_input/{name}.{kind}", name) for kind in ("xlsx", "csv")]
        lists[name] = fetch.numbered_records(own[0].unionByName(own[1]))
    out = materialize(fetch.fetch_all(fetch.Fetcher(client, f"{dataset}/01_raw_genomes"), lists), "counters")
    sinks.write_json(out, f"{dataset}/01_raw_genomes/counters")
    return out


def preprocess(spark: SparkSession, dataset: str, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Protein files of ``01_raw_genomes/CATEGORY`` to one table of sequences and one of their genomes; totals."""
    proteins = materialize(files.read_protein_folders(spark, {c: f"{dataset}/01_raw_genomes/{c}" for c in categories}), "proteins")
    proteins.select(F.col("protein_id").alias("name"), "sequence").write.mode("overwrite").parquet(f"{dataset}/02_preprocessing/all_proteins")
    sinks.write_csv(proteins.select("protein_id", "genome_accession", "taxon").orderBy("protein_id"), f"{dataset}/02_preprocessing/protein_metadata")
    return fetch.protein_totals(proteins)


def align(spark: SparkSession, dataset: str, params: similarity.SearchParams = similarity.SearchParams()) -> DataFrame:
    hits = materialize(similarity.align(spark.read.parquet(f"{dataset}/02_preprocessing/all_proteins"), params), "hits")
    sinks.write_tsv(hits, f"{dataset}/03_alignment/hits_cleaned")
    sinks.write_json(ranking.mean_similarity(hits), f"{dataset}/03_alignment/similarity_mean")
    return hits


def clusters(spark: SparkSession, dataset: str) -> DataFrame:
    found = materialize(graph.clusters(files.read_edges_of_hits(spark, f"{dataset}/03_alignment/hits_cleaned")), "members")
    sinks.write_tsv(found, f"{dataset}/04_networks/connected_components")
    return found


def network(spark: SparkSession, dataset: str) -> DataFrame:
    proteins = files.read_proteins(spark, f"{dataset}/02_preprocessing/protein_metadata")
    nodes, edges = graph.bipartite(graph.genome_cluster_counts(files.read_membership(spark, f"{dataset}/04_networks/connected_components"), proteins), proteins)
    sinks.write_nodes(nodes, f"{dataset}/04_networks/nodes")
    sinks.write_edges(edges, f"{dataset}/04_networks/edges")
    return nodes


def reduce(spark: SparkSession, dataset: str) -> DataFrame:
    base = f"{dataset}/04_networks"
    out = graph.reduce_network(files.read_nodes(spark, f"{base}/nodes"), files.read_edges(spark, f"{base}/edges"), files.read_membership(spark, f"{base}/connected_components"))
    sinks.write_nodes(out["nodes"], f"{base}/reduced_nodes")
    sinks.write_edges(out["edges"], f"{base}/reduced_edges")
    sinks.write_tsv(out["twin_groups"].orderBy("twin_group", "member_chg"), f"{base}/chg_twin_groups")
    sinks.write_tsv(out["membership"], f"{base}/reduced_chg_membership")
    sinks.write_csv(out["genomes"].distinct().orderBy("node_id"), f"{base}/genome_nodes")
    return out["genomes"]


def phylogeny(spark: SparkSession, dataset: str, client: ArchiveClient | None = None) -> DataFrame:
    """The species tree of the network's genomes, and the distances between them."""
    base = f"{dataset}/05_phylogeny"
    genomes = spark.read.csv(f"{dataset}/04_networks/genome_nodes", header=True).select(F.col("node_id").alias("accession"))
    tree.write_species_tree(materialize((client or recorded_client(spark, dataset)).taxonomy(genomes), "taxonomy"), base)
    nodes = materialize(tree.read_newick(spark, f"{base}/reduced_species_tree"), "tree")
    distances = materialize(tree.leaf_distances(nodes), "distances")
    sinks.write_tsv(distances.orderBy("genome_a", "genome_b"), f"{base}/pairwise_distances")
    sinks.write_json(tree.mean_distance(nodes), f"{base}/phylogeny_stats")
    return distances


def score(spark: SparkSession, dataset: str, method: ScoringMethod = ScoringMethod.EXPONENTIAL, replicates: int = 10_000) -> DataFrame:
    """Scores, thresholds, candidates and the report; the means come from the files of the stages before."""
    base = f"{dataset}/06_hgt"
    hits, proteins = files.read_hits(spark, f"{dataset}/03_alignment/hits_cleaned"), files.read_proteins(spark, f"{dataset}/02_preprocessing/protein_metadata")
    members, taxids = files.read_membership(spark, f"{dataset}/04_networks/reduced_chg_membership"), files.read_taxids(spark, f"{dataset}/05_phylogeny/genome_to_organism_name")
    distances = files.read_distances(spark, f"{dataset}/05_phylogeny/pairwise_distances")
    far = files.read_json_scalars(spark, f"{dataset}/05_phylogeny/phylogeny_stats", "n_int_mean double").where("n_int_mean is not null").first()
    near = files.read_json_scalars(spark, f"{dataset}/03_alignment/similarity_mean", "s_mean double").where("s_mean is not null").first()
    params = ranking.ScoringParams(method=method, n_int_mean=far["n_int_mean"] if far else 0.0, hits_mean=near["s_mean"] if near else ranking.mean_similarity(hits).first()["s_mean"])
    scores = materialize(ranking.score_hits(hits, proteins, taxids, members, distances, params), "scores")
    bounds = materialize(stats.bootstrap_quantiles(spark, scores, replicates=replicates), "bounds")
    first = bounds.first()
    found = stats.high_confidence(scores, first["upper"]) if first else scores.where("false")
    sinks.write_scores(ranking.by_score(scores), f"{base}/hgt_scores")
    sinks.write_tsv(ranking.by_score(found), f"{base}/high_confidence_hgt")
    sinks.write_tsv(ranking.by_score(restore_names(found, proteins, taxids)), f"{base}/high_confidence_hgt_original_names")
    sinks.write_json(sinks.thresholds(bounds), f"{base}/hgt_thresholds")
    text = sinks.report(method.value, stats.describe(scores), stats.fit_distributions(scores), bounds, found.count(), scores.count())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/report")
    return scores


def transfer(spark: SparkSession, dataset: str) -> DataFrame:
    return run_transfers(spark, dataset)["significant"]


STAGES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fetch": fetch_stage, "preprocess": preprocess, "align": align, "clusters": clusters, "network": network, "reduce": reduce, "phylogeny": phylogeny, "score": score, "transfer": transfer,
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="One stage of the analysis of a dataset folder.")
    p.add_argument("stage", choices=list(STAGES))
    p.add_argument("dataset")
    args = p.parse_args(argv)
    try:
        STAGES[args.stage](session(), args.dataset).show(20, truncate=False)
    except Exception as e:  # the exit code tells callers
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
