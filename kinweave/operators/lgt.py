"""Lateral transfers by taxon pair: hits between genomes, best per cluster, significance, merge with scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pair, pair_label
from .joins import join_lookup
from .ranking import best_of, hit_order


def genome_hits(hits: DataFrame, proteins: DataFrame, membership: DataFrame) -> DataFrame:
    """Hits between genomes with taxa and the query's cluster; a hit with an unmapped side stays, with a null pair."""
    p = proteins.select("protein_id", "genome_accession", "taxon")
    d = hits.join(p.toDF("query", "query_genome", "query_taxon"), "query", "left").join(membership.select(F.col("protein_id").alias("query"), F.col("chg_id").alias("chg")), "query", "left")
    d = d.join(p.toDF("target", "target_genome", "target_taxon"), "target", "left")  # after both joins by query, which share a shuffle
    return between_genomes(d)


def between_genomes(hits: DataFrame, *held: str) -> DataFrame:
    """``genome_hits`` of hits that carry the genomes and taxa of both sides and the query's cluster already; further columns are held."""
    d = hits.where(F.coalesce(F.col("query_genome") != F.col("target_genome"), F.lit(True)))
    return d.select(*held, "query", "target", "query_genome", "target_genome", "query_taxon", "target_taxon", "chg", pair_label(F.col("query_taxon"), F.col("target_taxon")).alias("taxon_pair"), "pident", "alnlen", "evalue", "bits")


def best_per_cluster(hits: DataFrame, *of_cluster: str) -> DataFrame:
    """The greatest identity of each (chg, taxon_pair); null keys go.

    of_cluster: columns of which a cluster has one value. They are part of the key and then
    go, so that hits which are partitioned by one of them are not shuffled.
    """
    d = hits.where("chg is not null and taxon_pair is not null")
    keys = [*of_cluster, "chg", "taxon_pair"]
    held = [c for c in d.columns if c not in (*keys, "pident", "query", "target")]  # what stands in the key or the tie is not shuffled again
    best = best_of(d, keys, "pident", hit_order(), held)
    other = F.when(F.col("f.t2") == F.col("f.t0"), F.col("f.t1")).otherwise(F.col("f.t0"))
    own = {"query": F.col("f.t2"), "target": other, "pident": -F.col("f.v")} | {c: F.col(f"f.{c}") for c in held}
    return best.select(*[own[c].alias(c) if c in own else c for c in d.columns if c not in of_cluster])


def in_order(hits: DataFrame) -> DataFrame:
    """By cluster and taxon pair."""
    return hits.orderBy("chg", "taxon_pair", "query", "target")


def mark_significant(hits: DataFrame, bounds: DataFrame) -> DataFrame:
    return join_lookup(hits, bounds, "taxon_pair").withColumn("is_significant", F.col("pident") > F.col("q95_upper_bound"))


def breakdown(marked: DataFrame) -> DataFrame:
    """(taxon_pair, significant, total, percentage), most first."""
    d = marked.groupBy("taxon_pair").agg(F.count_if("is_significant").alias("significant"), F.count("*").alias("total"))
    return d.withColumn("percentage", 100.0 * F.col("significant") / F.col("total")).orderBy(F.desc("significant"), "taxon_pair")


def merge_scores(significant: DataFrame, scores: DataFrame) -> DataFrame:
    """significant hits with the score of their unordered protein pair; of several the least."""
    lo, hi = pair(F.col("protein_A"), F.col("protein_B"))
    one = scores.groupBy(lo.alias("_lo"), hi.alias("_hi")).agg(F.min("HGT_score").alias("HGT_score"))
    a, b = pair(F.col("query"), F.col("target"))
    return significant.join(one, (a == F.col("_lo")) & (b == F.col("_hi"))).drop("_lo", "_hi")


def merge_summary(significant: DataFrame, merged: DataFrame) -> DataFrame:
    m = merged.agg(F.count("*").alias("matched"), F.min("HGT_score").alias("min_score"), F.max("HGT_score").alias("max_score"), F.avg("HGT_score").alias("mean_score"), F.countDistinct("taxon_pair").alias("taxon_pairs"))
    return m.crossJoin(significant.agg(F.count("*").alias("total"))).withColumn("match_ratio", F.col("matched") / F.nullif(F.col("total"), F.lit(0)))  # two single rows


def extremes(merged: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """The n highest and the n lowest scores."""
    tie = ["query", "target"]
    return merged.orderBy(F.desc("HGT_score"), *tie).limit(n), merged.orderBy("HGT_score", *tie).limit(n)
