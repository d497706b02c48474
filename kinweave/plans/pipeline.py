"""The whole analysis of one dataset folder, from sequences and a tree to candidates.

    spark-submit kinweave/plans/cli.py DATASET --min_coverage 0.8 --min_identity 0.59
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scorers import ScoringMethod
from ..operators import graph, lgt, ranking, similarity, stats, tree
from ..runtime import Timings, drop_scratch, materialize
from ..sources import files, sinks


def measured(scoring: ranking.ScoringParams, hits: DataFrame, nodes: DataFrame) -> ranking.ScoringParams:
    """The parameters with the means that the classic score divides by: of all leaf distances and of all hits' identities."""
    far = tree.mean_distance(nodes).first()["n_int_mean"]
    return replace(scoring, n_int_mean=float(far), hits_mean=float(ranking.mean_similarity(hits).first()["s_mean"]))


@dataclass
class Analysis:
    spark: SparkSession
    dataset: str
    search: similarity.SearchParams = field(default_factory=lambda: similarity.SearchParams(min_identity=0.59))
    scoring: ranking.ScoringParams = field(default_factory=ranking.ScoringParams)
    replicates: int = 10_000
    #: write the distances of all pairs of leaves; scoring itself only takes the pairs that hits name
    all_distances: bool = True
    timings: Timings = field(default_factory=Timings)
    _scratch: list[DataFrame] = field(default_factory=list)

    def _keep(self, df: DataFrame, tag: str) -> DataFrame:
        self._scratch.append(materialize(df, tag))
        return self._scratch[-1]

    def close(self) -> None:
        """Deletes the tables that the steps wrote for themselves; what ``write`` wrote stays."""
        drop_scratch(*self._scratch)
        self._scratch.clear()

    def prepare(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(sequences, proteins, taxids); one protein for each organism."""
        genomes = self._keep(files.name_map(files.read_inputfile(self.spark, f"{self.dataset}/00_input/inputfile")), "genomes")
        taxids = tree.assign_taxids(genomes)
        d = genomes.withColumn("protein_id", F.concat_ws("_", F.lit("unknown"), "genome_accession", F.concat("genome_accession", F.lit("_1")), F.lit("protein"), F.lit("1")))
        return d.select(F.col("protein_id").alias("name"), "sequence"), d.select("protein_id", "genome_accession", F.lit("unknown").alias("taxon")), taxids

    @staticmethod
    def _genome_pairs(hits: DataFrame, proteins: DataFrame) -> DataFrame:
        own = ranking.join_genomes(hits.select("query", "target"), proteins).where("genome_a <> genome_b")
        return own.select(F.least("genome_a", "genome_b").alias("genome_a"), F.greatest("genome_a", "genome_b").alias("genome_b"))

    def run(self, write: bool = True) -> dict[str, DataFrame]:
        step, keep = self.timings.step, self._keep
        sequences, proteins, taxids = self.prepare()
        proteins, taxids = keep(proteins, "proteins"), keep(taxids, "taxids")
        with step("Alignment"):
            hits = keep(similarity.align(sequences, self.search), "hits")
        with step("Clusters"):
            members = keep(graph.clusters(hits), "members")
        with step("Network construction"):
            nodes, edges = (keep(d, "net") for d in graph.bipartite(graph.genome_cluster_counts(members, proteins), proteins))
        with step("Network reduction"):
            reduced = graph.reduce_network(nodes, edges, members)
        with step("Tree distances"):
            names = taxids.select(F.col("organism_name").alias("old"), F.col("genome_accession").alias("new"))
            leaves = keep(tree.rename_nodes(tree.read_newick(self.spark, f"{self.dataset}/00_input/tree.newick"), names), "tree")
            distances = keep(tree.pair_distances(leaves, self._genome_pairs(hits, proteins)), "distances")
        with step("Scoring"):
            self.scoring = measured(self.scoring, hits, leaves)
            scores = keep(ranking.score_hits(hits, proteins, taxids, reduced["membership"].select("protein_id", "chg_id"), distances, self.scoring), "scores")
        with step("Significance"):
            bounds = keep(stats.bootstrap_quantiles(self.spark, scores, replicates=self.replicates), "bounds")
            first = bounds.first()
            candidates = stats.high_confidence(scores, first["upper"]) if first else scores.where("false")
        out = {
            "proteins": proteins, "taxids": taxids, "hits": hits, "membership": members, "nodes": nodes, "edges": edges, "reduced_nodes": reduced["nodes"], "reduced_edges": reduced["edges"],
            "twin_groups": reduced["twin_groups"], "reduced_membership": reduced["membership"], "distances": tree.leaf_distances(leaves) if self.all_distances else distances, "summary": tree.mean_distance(leaves), "scores": ranking.by_score(scores),
            "bounds": bounds, "candidates": ranking.by_score(candidates), "scores_named": ranking.by_score(restore_names(scores, proteins, taxids)), "candidates_named": ranking.by_score(restore_names(candidates, proteins, taxids)),
        }
        if write:
            self.write(out)
        return out

    def write(self, out: dict[str, DataFrame]) -> None:
        base = self.dataset
        sinks.write_csv(out["proteins"].orderBy("protein_id"), f"{base}/02_preprocessing/protein_metadata")
        for name, place in {"hits": "03_alignment/hits_cleaned", "membership": "04_networks/connected_components", "twin_groups": "04_networks/chg_twin_groups", "reduced_membership": "04_networks/reduced_chg_membership", "distances": "05_phylogeny/pairwise_distances"}.items():
            sinks.write_tsv(out[name], f"{base}/{place}")
        for name in ("nodes", "reduced_nodes"):
            sinks.write_nodes(out[name], f"{base}/04_networks/{name}")
        for name in ("edges", "reduced_edges"):
            sinks.write_edges(out[name], f"{base}/04_networks/{name}")
        sinks.write_csv(out["taxids"].orderBy("genome_accession"), f"{base}/05_phylogeny/genome_to_organism_name")
        sinks.write_json(out["summary"], f"{base}/05_phylogeny/phylogeny_stats")
        sinks.write_json(ranking.mean_similarity(out["hits"]), f"{base}/03_alignment/similarity_mean")
        for name, place in {"scores": "hgt_scores", "scores_named": "hgt_scores_original_names"}.items():
            sinks.write_scores(out[name], f"{base}/06_hgt/{place}")
        for name, place in {"candidates": "high_confidence_hgt", "candidates_named": "high_confidence_hgt_original_names"}.items():
            sinks.write_tsv(out[name], f"{base}/06_hgt/{place}")
        sinks.write_json(sinks.thresholds(out["bounds"]), f"{base}/06_hgt/hgt_thresholds")

    def report(self, out: dict[str, DataFrame]) -> str:
        scores = out["scores"]
        return sinks.report(self.scoring.method.value, stats.describe(scores), stats.fit_distributions(scores), out["bounds"], out["candidates"].count(), scores.count()) + "\n" + self.timings.report() + "\n"


def restore_names(scores: DataFrame, proteins: DataFrame, taxids: DataFrame) -> DataFrame:
    """Protein ids replaced by organism names, by join; an unmapped id stays."""
    names = proteins.join(taxids, "genome_accession").select("protein_id", "organism_name")
    columns = scores.columns
    for c in ("protein_A", "protein_B"):
        scores = scores.join(names.select(F.col("protein_id").alias(c), F.col("organism_name").alias("_n")), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
    return scores.select(*columns)


def transfers(hits: DataFrame, proteins: DataFrame, membership: DataFrame, scores: DataFrame | None = None, replicates: int = 10_000) -> dict[str, DataFrame]:
    """The track by taxon pair: hits between genomes, best per cluster, significant ones, merged with scores."""
    found = lgt.genome_hits(hits, proteins, membership)
    best = materialize(lgt.best_per_cluster(found), "best")
    bounds = materialize(stats.grouped_bootstrap(best, replicates=replicates), "bounds")
    marked = materialize(lgt.mark_significant(best, bounds), "marked")
    out = {"genome_hits": found, "best": lgt.in_order(best), "bounds": bounds.orderBy("taxon_pair"), "significant": lgt.in_order(marked.where("is_significant")), "breakdown": lgt.breakdown(marked)}
    if scores is not None:
        merged = materialize(lgt.merge_scores(marked.where("is_significant"), scores), "merged")
        out |= {"merged": lgt.in_order(merged), "summary": lgt.merge_summary(marked.where("is_significant"), merged)}
        out |= dict(zip(("highest", "lowest"), lgt.extremes(merged), strict=True))
    return out


def run_transfers(spark: SparkSession, dataset: str, replicates: int = 10_000) -> dict[str, DataFrame]:
    """The track over the files of an analysed dataset folder; its tables are written to ``07_lgt``."""
    hits = files.read_hits(spark, f"{dataset}/03_alignment/hits_cleaned")
    proteins = files.read_proteins(spark, f"{dataset}/02_preprocessing/protein_metadata")
    members = files.read_membership(spark, f"{dataset}/04_networks/reduced_chg_membership")
    out = transfers(hits, proteins, members, files.read_scores(spark, f"{dataset}/06_hgt/hgt_scores"), replicates)
    for name, place in {"genome_hits": "genome_hits", "best": "filtered_genome_hits", "significant": "significant_hits", "merged": "significant_hits_with_scores"}.items():
        sinks.write_transfers(out[name], f"{dataset}/07_lgt/{place}")
    sinks.write_tsv(out["bounds"], f"{dataset}/07_lgt/bootstrap_bounds")
    sinks.write_tsv(out["breakdown"], f"{dataset}/07_lgt/breakdown")
    return out


METHODS = list(ScoringMethod)
