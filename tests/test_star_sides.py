"""The star's hits carry what other hits get by joins: the same rows, in fewer shuffles."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from kinweave.operators import lgt, ranking
from kinweave.plans import queries as network
from kinweave.plans.adapters import Star

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("taxa", ["nation", "supplier"])
def test_hits_that_carry_their_sides(spark, taxa):
    s = Star(spark, DATA, taxa).shared()
    joined = network._joined(s).drop("alnlen", "evalue", "bits")
    assert rows(network._annotated(s)) == rows(joined) and joined.where("chg is null").count()
    assert rows(s.transfers) == rows(lgt.genome_hits(s.hits, s.proteins, s.membership))
    both = ranking.symmetric_best(joined)
    assert rows(ranking.symmetric_best(joined.drop("genome_a", "genome_b"))) == rows(both.drop("genome_a", "genome_b"))


def test_scores_shuffle_hits_by_few_keys(spark):
    """Items by part, best hits, and ends of ranks; no shuffle of hits by protein or genome pair."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = network.queries()["sco_07_ranking_th"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = set(re.findall(r"Exchange hashpartitioning\((\w+?)#", plan))
    assert keys == {"l_partkey", "part", "supp", "s_suppkey", "s_nationkey", "n_nationkey", "chg"} & keys | {"chg"}, keys


def test_best_transfers_are_reduced_where_hits_are_joined(spark):
    """The rows of the operator over the joined tables, with one shuffle: that of items by part."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        s = Star(spark, DATA)
        plan = s.best_transfers._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"Exchange hashpartitioning\((\w+?)#", plan)) == {"part"}
        assert rows(s.best_transfers) == rows(lgt.best_per_cluster(lgt.genome_hits(s.hits, s.proteins, s.membership)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("split", ["128m", "2k"])
@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_places_in_written_files(spark, tmp_path, split, compression):
    """Rows of several files and splits are numbered through, without a shuffle of rows; odd values stay."""
    odd = ["plain", 'quo"te', "ta\tb", "é😀", None]
    df = spark.range(1000).select((999 - F.col("id")).alias("id"), F.get(F.array(*[F.lit(x) for x in odd]), (F.col("id") % 5).cast("int")).alias("name"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = str(tmp_path / "rows")
        network.sinks.write_tsv(df.repartitionByRange(5, "id").sortWithinPartitions("id"), path, compression)
        placed = network._placed(spark, path, "\t")
        assert [(r["place"], int(r["id"]), r["name"]) for r in sorted(placed.collect(), key=lambda r: r["place"])] == [(i + 1, i, odd[(999 - i) % 5]) for i in range(1000)]
        assert set(re.findall(r"Exchange hashpartitioning\((\w+?)#", placed._jdf.queryExecution().executedPlan().toString())) <= {"_split"}
        assert network._placed(spark, path, "\t").where("id = '7'").first()["place"] == 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
