"""From hits to scores: joins, best hits, symmetry, ranks, statistics, scores.

Ties go to the hit whose unordered pair comes first (``hit order``), then to the
earlier taxon, so that results do not depend on row order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pair
from ..functions.scorers import ScoringMethod, scorer
from ..runtime import materialize
from .joins import join_lookup


@dataclass(frozen=True)
class ScoringParams:
    min_phylogenetic_distance: int = 2
    method: ScoringMethod = ScoringMethod.RANKING_TH
    rank_threshold: float = 0.5
    n_int_mean: float = 0.0
    hits_mean: float = 0.0
    exponent: float = 1.0


def _both(hits: DataFrame, table: DataFrame, key: str, value: str, left: tuple[str, str], out: tuple[str, str], how: str = "inner") -> DataFrame:
    """hits with the value of each of two key columns."""
    for source, name in zip(left, out, strict=True):
        one = table.select(F.col(key).alias(f"_k_{name}"), F.col(value).alias(name))
        hits = hits.join(one, F.col(source) == F.col(f"_k_{name}"), how).drop(f"_k_{name}")
    return hits


def join_genomes(hits: DataFrame, proteins: DataFrame) -> DataFrame:
    """Both proteins' genomes; hits with an unmapped protein go."""
    return _both(hits, proteins, "protein_id", "genome_accession", ("query", "target"), ("genome_a", "genome_b"))


def join_taxa(hits: DataFrame, taxids: DataFrame) -> DataFrame:
    """Both genomes' taxa, which must differ and not be empty."""
    joined = _both(hits, taxids, "genome_accession", "taxid", ("genome_a", "genome_b"), ("tax_a", "tax_b"))
    return joined.where("tax_a <> tax_b and tax_a <> '' and tax_b <> ''")


def join_clusters(hits: DataFrame, membership: DataFrame) -> DataFrame:
    """Both proteins in one cluster, or both in none."""
    joined = _both(hits, membership, "protein_id", "chg_id", ("query", "target"), ("chg", "_chg_b"), "left")
    return joined.where(F.col("chg").eqNullSafe(F.col("_chg_b"))).drop("_chg_b")


def join_distances(hits: DataFrame, distances: DataFrame) -> DataFrame:
    """The genomes' distance, 0 where there is none. Of several distances of a pair the largest counts."""
    a, b = pair(F.col("genome_a"), F.col("genome_b"))
    lo, hi = pair(F.col("genome_a"), F.col("genome_b"))
    one = distances.select(lo.alias("_lo"), hi.alias("_hi"), F.col("N_int").alias("n_int")).groupBy("_lo", "_hi").agg(F.max("n_int").alias("n_int"))
    joined = hits.join(one, (a == F.col("_lo")) & (b == F.col("_hi")), "left").drop("_lo", "_hi")
    return joined.withColumn("n_int", F.coalesce("n_int", F.lit(0)))


def annotate(hits: DataFrame, proteins: DataFrame, taxids: DataFrame, membership: DataFrame, distances: DataFrame) -> DataFrame:
    """The hits that ``join_genomes``, ``join_taxa`` and ``join_clusters`` leave, with their distance.

    What a protein has, genome, taxon and cluster, is joined into one table first, so
    that hits are shuffled once for each side.
    """
    own = proteins.select("protein_id", "genome_accession").join(taxids.select("genome_accession", "taxid").where("taxid <> ''"), "genome_accession")
    own = own.join(membership.select("protein_id", "chg_id"), "protein_id", "left").select("protein_id", "genome_accession", "taxid", "chg_id")
    d = hits.join(own.toDF("query", "genome_a", "tax_a", "chg"), "query").join(own.toDF("target", "genome_b", "tax_b", "_chg_b"), "target")
    return join_distances(of_sides(d), distances)


def of_sides(hits: DataFrame) -> DataFrame:
    """``annotate`` of hits that carry the taxa (tax_a, tax_b) and clusters (chg, _chg_b) of both sides already: those of two taxa, none empty, in one cluster or both in none."""
    return hits.where((F.col("tax_a") != F.col("tax_b")) & (F.col("tax_a") != "") & (F.col("tax_b") != "") & F.col("chg").eqNullSafe(F.col("_chg_b"))).drop("_chg_b")


def hit_order(query: str = "query", target: str = "target") -> list[Column]:
    return [*pair(F.col(query), F.col(target)), F.col(query)]


def _greatest_first(value: str, tie: list[Column]) -> list[Column]:
    """Fields of a struct whose least has the greatest value, then the first tie."""
    v = F.col(value)
    return [v.isNull().alias("none"), (~F.isnan(v)).alias("nan"), (-v).alias("v"), *[c.alias(f"t{i}") for i, c in enumerate(tie)]]


def greatest_of(rows: DataFrame, keys: list[Column], value: str, tie: list[Column]) -> DataFrame:
    """Of each key the row of the greatest value, of equal ones the first in order of the tie; columns as before.

    An aggregation, not a window: partitions are reduced before the shuffle, so a key
    that many rows share, such as that of hits in no cluster, is no hot task.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    first = F.struct(*_greatest_first(value, tie), F.struct("*").alias("row"))
    return rows.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min(first).alias("_b")).select("_b.row.*")


def best_of(rows: DataFrame, keys: list[str | Column], value: str, tie: list[Column], held: list[str | Column]) -> DataFrame:
    """The keys and f, of each key the struct (none, nan, v = -value, t0, t1, ... of the tie, held columns) of the row that ``greatest_of`` takes."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*_greatest_first(value, tie), *held)).alias("f"))


#: What an annotated hit may carry besides, which scores do not need.
_GENOMES = ("genome_a", "genome_b")


def best_hits(annotated: DataFrame, directional: bool) -> DataFrame:
    """The hit of greatest similarity for each (cluster, taxon pair); ordered pairs if directional. Genomes are kept where hits have them."""
    key = (F.col("tax_a"), F.col("tax_b")) if directional else pair(F.col("tax_a"), F.col("tax_b"))
    turned = F.lit(False) if directional else F.col("tax_a") > F.col("tax_b")
    # names that stand in the key or the tie are not shuffled again
    genomes = [c for c in _GENOMES if c in annotated.columns]
    rows = annotated.select("chg", "tax_a", "tax_b", "query", "target", *genomes, "n_int", F.col("pident").cast("double").alias("pident"))
    d = best_of(rows, ["chg", key[0].alias("_a"), key[1].alias("_b")], "pident", hit_order(), [turned.alias("turned"), *genomes, "n_int"])
    tax = [F.when(F.col("f.turned"), F.col(x)).otherwise(F.col(y)) for x, y in (("_b", "_a"), ("_a", "_b"))]
    other = F.when(F.col("f.t2") == F.col("f.t0"), F.col("f.t1")).otherwise(F.col("f.t0"))
    return d.select("chg", tax[0].alias("tax_a"), tax[1].alias("tax_b"), F.col("f.t2").alias("prot_a"), other.alias("prot_b"), *[f"f.{c}" for c in genomes], "f.n_int", (-F.col("f.v")).alias("similarity"))


def without_reverse(best: DataFrame) -> DataFrame:
    """The hits of which no hit in the other direction stands in the same cluster."""
    keys = best.select(F.col("chg").alias("_chg"), F.col("tax_b").alias("_tax_a"), F.col("tax_a").alias("_tax_b"))
    same = F.col("chg").eqNullSafe(F.col("_chg")) & (F.col("tax_a") == F.col("_tax_a")) & (F.col("tax_b") == F.col("_tax_b"))
    return best.join(keys, same, "left_anti")


def symmetrize(best: DataFrame) -> DataFrame:
    """Adds the reverse of each hit whose reverse is absent."""
    swap = {"tax_a": "tax_b", "tax_b": "tax_a", "prot_a": "prot_b", "prot_b": "prot_a", "genome_a": "genome_b", "genome_b": "genome_a"}
    return best.unionByName(without_reverse(best).select([F.col(swap.get(c, c)).alias(c) for c in best.columns]))


def symmetric_best(annotated: DataFrame) -> DataFrame:
    """``symmetrize(best_hits(annotated, True))`` with _lo and _hi, the taxa in order, by which the rows are shuffled.

    Both directions of a pair of taxa are found in one aggregation, so that no hit is joined with its reverse.
    """
    lo, hi = pair(F.col("tax_a"), F.col("tax_b"))
    genomes = [c for c in _GENOMES if c in annotated.columns]
    first = F.struct(*_greatest_first("pident", hit_order()), F.struct(*genomes, "n_int").alias("row"))
    rows = annotated.select("chg", "tax_a", "tax_b", "query", "target", *genomes, "n_int", F.col("pident").cast("double").alias("pident"))
    forward = F.col("tax_a") <= F.col("tax_b")
    d = rows.groupBy("chg", lo.alias("_lo"), hi.alias("_hi")).agg(F.min(F.when(forward, first)).alias("f"), F.min(F.when(~forward, first)).alias("b"))

    def hit(found: str, tax_a: str, tax_b: str, turned: bool) -> Column:
        f = lambda c: F.col(f"{found}.{c}")
        other = F.when(f("t2") == f("t0"), f("t1")).otherwise(f("t0"))
        sides = [(other if turned else f("t2")).alias("prot_a"), (f("t2") if turned else other).alias("prot_b")]
        sides += [f(f"row.{g}").alias(c) for c, g in zip(genomes, genomes[::-1] if turned else genomes, strict=True)]
        return F.struct(F.col(tax_a).alias("tax_a"), F.col(tax_b).alias("tax_b"), *sides, f("row.n_int").alias("n_int"), (-f("v")).alias("similarity"))

    ahead = F.when(F.col("f").isNotNull(), hit("f", "_lo", "_hi", False)).otherwise(hit("b", "_lo", "_hi", True))
    back = F.when(F.col("b").isNotNull(), hit("b", "_hi", "_lo", False)).otherwise(hit("f", "_hi", "_lo", True))
    both = F.when(F.col("_lo") == F.col("_hi"), F.array(ahead)).otherwise(F.array(ahead, back))
    return d.select("chg", F.explode(both).alias("e"), "_lo", "_hi").select("chg", "e.*", "_lo", "_hi")


def far_apart(best: DataFrame, min_distance: int = 2) -> DataFrame:
    """The hits of genomes that are so far apart in the tree."""
    return best.where(F.col("n_int") >= min_distance)


def _at_ends(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(chg, kept columns, tax, neighbor, own, sim), shuffled by cluster and taxon, which ranks need: rows at their tax_a, and those without a reverse at tax_b too (not own)."""
    if "_lo" not in rows.columns:
        lo, hi = pair(F.col("tax_a"), F.col("tax_b"))
        rows = rows.withColumns({"_lo": lo, "_hi": hi})
    w, ahead = Window.partitionBy("chg", "_lo", "_hi"), F.col("tax_a") == F.col("_lo")
    alone = (F.min(ahead).over(w) == F.max(ahead).over(w)) & (F.col("_lo") != F.col("_hi"))
    here = F.struct(F.col("tax_a").alias("tax"), F.col("tax_b").alias("neighbor"), F.lit(True).alias("own"))
    there = F.struct(F.col("tax_b").alias("tax"), F.col("tax_a").alias("neighbor"), F.lit(False).alias("own"))
    d = rows.withColumns({"sim": F.max("similarity").over(w), "_alone": alone})
    return d.select("chg", *keep, "sim", F.explode(F.when(F.col("_alone"), F.array(here, there)).otherwise(F.array(here))).alias("e")).select("chg", *keep, "sim", "e.*").repartition("chg", "tax")


def adjacency(best: DataFrame, min_distance: int = 2) -> DataFrame:
    """(chg, tax, neighbor, sim): the greatest similarity in either direction."""
    return _at_ends(far_apart(best, min_distance), []).groupBy("chg", "tax", "neighbor").agg(F.max("sim").alias("sim"))


def simple_ranks(adj: DataFrame) -> DataFrame:
    w = Window.partitionBy("chg", "tax").orderBy(F.desc("sim"), "neighbor")
    return adj.withColumn("rank", F.row_number().over(w))


def threshold_ranks(adj: DataFrame, threshold: float) -> DataFrame:
    """The rank grows where the similarity falls by more than the threshold from one neighbour to the next."""
    w = Window.partitionBy("chg", "tax").orderBy(F.desc("sim"), "neighbor")
    gap = F.coalesce((F.lag("sim").over(w) - F.col("sim") > threshold).cast("int"), F.lit(0))
    d = adj.withColumn("_gap", gap)
    return d.withColumn("rank", (1 + F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int")).drop("_gap")


def with_ranks(rows: DataFrame, threshold: float | None) -> DataFrame:
    """rows with the rank of tax_b among the neighbours of tax_a: of ``simple_ranks`` (no threshold) or ``threshold_ranks`` over their ``adjacency``."""
    columns = rows.drop("_lo", "_hi").columns
    d = _at_ends(rows, [c for c in columns if c not in ("chg", "tax_a", "tax_b")])  # at its own end a row's taxa are tax and neighbor
    w = Window.partitionBy("chg", "tax").orderBy(F.desc("sim"), "neighbor")
    if threshold is None:
        d = d.withColumn("rank", F.dense_rank().over(w))
    else:
        d = d.withColumn("_gap", F.coalesce((F.lag("sim").over(w) - F.col("sim") > threshold).cast("int"), F.lit(0)))
        d = d.withColumn("rank", (1 + F.sum("_gap").over(w.rangeBetween(Window.unboundedPreceding, 0))).cast("int"))
    return d.where("own").withColumnsRenamed({"tax": "tax_a", "neighbor": "tax_b"}).select(*columns, "rank")


def mean_similarity(hits: DataFrame) -> DataFrame:
    """One row: the mean of the valid identities, 0 if there are none."""
    return hits.agg(F.coalesce(F.avg(F.col("pident").try_cast("double")), F.lit(0.0)).alias("s_mean"))


def stats_by_distance(best: DataFrame) -> DataFrame:
    """(n_int, mu, sigma) for distances over 0; a single or constant sample has sigma 1."""
    sd = F.stddev_samp("similarity")
    return best.where("n_int > 0").groupBy("n_int").agg(F.avg("similarity").alias("mu"), F.when(sd > 0, sd).otherwise(1.0).alias("sigma"))


def stats_by_taxon(best: DataFrame) -> DataFrame:
    """(tax, tax_mu, tax_sd): each hit counts for both taxa; the deviation is 2 at least."""
    d = best.select(F.explode(F.array("tax_a", "tax_b")).alias("tax"), "similarity")
    return d.groupBy("tax").agg(F.avg("similarity").alias("tax_mu"), F.greatest(F.stddev_pop("similarity"), F.lit(2.0)).alias("tax_sd"))


def distance_cdf(best: DataFrame) -> DataFrame:
    """(n_int, cdf). The running sum is over distinct distances."""
    counts = best.groupBy("n_int").agg(F.count("*").alias("n"))
    upto = Window.orderBy("n_int").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("n_int", (F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy())).alias("cdf"))


def max_distance(best: DataFrame, min_distance: int = 2) -> DataFrame:
    return far_apart(best, min_distance).agg(F.coalesce(F.max("n_int"), F.lit(10)).alias("n_int_max"))


def scored(best: DataFrame, params: ScoringParams) -> DataFrame:
    """Scores of best hits (already symmetric for the ranking methods)."""
    m = params.method
    if not m.ranks and m is not ScoringMethod.CLASSIC:  # read again for statistics
        best = materialize(best, "best")
    d = best.where(F.col("n_int") >= params.min_phylogenetic_distance)
    if m.ranks:
        d = with_ranks(d.drop("genome_a", "genome_b"), None if m is ScoringMethod.RANKING else params.rank_threshold)
    else:
        d = d.withColumn("rank", F.lit(0))
    d = d.withColumns({"n_int_mean": F.lit(params.n_int_mean), "s_mean": F.lit(params.hits_mean)})
    if m in (ScoringMethod.ZSCORE, ScoringMethod.MODIFIED, ScoringMethod.COMBINED, ScoringMethod.EXPONENTIAL):
        d = join_lookup(d, stats_by_distance(best), "n_int", "left")
    if m is ScoringMethod.COMBINED:
        d = d.crossJoin(F.broadcast(max_distance(best, params.min_phylogenetic_distance)))  # one row
    if m is ScoringMethod.EXPONENTIAL:
        taxa = stats_by_taxon(best)
        for side in "ab":
            d = join_lookup(d, taxa.select(F.col("tax").alias(f"tax_{side}"), F.col("tax_mu").alias(f"tax_mu_{side}"), F.col("tax_sd").alias(f"tax_sd_{side}")), f"tax_{side}", "left")
        d = join_lookup(d, distance_cdf(best), "n_int", "left")
    score = scorer(m)(params.exponent) if m is ScoringMethod.EXPONENTIAL else scorer(m)()
    return d.select(
        F.col("prot_a").alias("protein_A"), F.col("prot_b").alias("protein_B"), F.col("chg").alias("CHG"), F.col("tax_a").alias("TaxID_A"), F.col("tax_b").alias("TaxID_B"),
        F.col("n_int").alias("N_int"), F.col("similarity").alias("s_AB"), F.col("rank").alias("Rank"), score.alias("HGT_score"),
    )


def score_hits(hits: DataFrame, proteins: DataFrame, taxids: DataFrame, membership: DataFrame, distances: DataFrame, params: ScoringParams) -> DataFrame:
    """hits to scores, unordered; ``by_score`` sorts them."""
    return score_annotated(annotate(hits, proteins, taxids, membership, distances), params)


def score_annotated(annotated: DataFrame, params: ScoringParams) -> DataFrame:
    """``score_hits`` of annotated hits."""
    annotated = annotated.drop(*_GENOMES)
    return scored(symmetric_best(annotated) if params.method.ranks else best_hits(annotated, False), params)


def by_score(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("HGT_score"), "CHG", "TaxID_A", "TaxID_B")
