"""The jobs as queries: each runs its function twice into one new folder and returns what stands there then, with SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import new_hits, shared_clusters
from kinweave.runtime import scratch_path


def job1_shared_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "job1")
    for _ in range(2):
        shared_clusters.run(spark, f"{sf_dir}/documents.parquet", folder)
    members = spark.read.schema("protein_id string, chg_id string, genome string, n_proteins bigint, n_genomes bigint, n_taxa bigint, taxon string").parquet(f"{folder}/members")
    edges = spark.read.schema("source string, target string, weight bigint, taxon string").parquet(f"{folder}/edges")
    best = spark.read.schema("chg string, query string, target string, query_genome string, target_genome string, query_taxon string, target_taxon string, pident double, taxon_pair string").parquet(f"{folder}/transfers")
    pairs = best.groupBy(F.col("chg").alias("chg_id")).agg(F.count("*").alias("taxon_pairs"), F.round(F.max("pident"), 6).alias("best_pident"))
    own = members.join(edges.select(F.col("source").alias("genome"), F.col("target").alias("chg_id"), "weight"), ["genome", "chg_id"])
    return own.join(pairs, "chg_id", "left").select("protein_id", "chg_id", "genome", "taxon", "n_proteins", "n_genomes", "n_taxa", "weight", F.coalesce("taxon_pairs", F.lit(0)).alias("taxon_pairs"), "best_pident")


def job2_new_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "job2")
    for _ in range(2):
        new_hits.run(spark, f"{sf_dir}/documents*.parquet", f"{folder}/out", f"{folder}/checkpoint")
    d = new_hits.hits(spark, f"{folder}/out")
    return d.select("query", "target", F.round("pident", 6).alias("pident"), "query_genome", "target_genome", "query_taxon", "target_taxon", "kind", "taxon_pair")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_shared_clusters, job2_new_hits)}


#: Sets of five-word runs; of equal sets the least id; links of 80 % or more between different sets, and copies. Job 1's transfers are of all pairs, copies included.
_HITS = """w AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS name, source AS genome, lang AS taxon, string_split(text, ' ') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT name, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle FROM (SELECT name, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
sets AS MATERIALIZED (SELECT name, count(*) AS n, list_sort(list(shingle)) AS s FROM sh GROUP BY name),
named AS MATERIALIZED (SELECT name, n, min(name) OVER (PARTITION BY s) AS rep FROM sets),
rs AS MATERIALIZED (SELECT sh.name, shingle, n FROM sh JOIN named ON sh.name = named.name WHERE rep = named.name),
near AS MATERIALIZED (SELECT a.name AS query, b.name AS target, 100.0 * count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS pident, 'near' AS kind FROM rs a JOIN rs b ON a.shingle = b.shingle AND a.name < b.name
  GROUP BY a.name, b.name HAVING 100.0 * count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 80),
hits AS MATERIALIZED (SELECT * FROM near UNION ALL SELECT rep, name, CAST(100 AS DOUBLE), 'copy' FROM named WHERE rep <> name)"""
_JOB2 = f"""WITH {_HITS}
SELECT query, target, round(pident, 6) AS pident, a.genome AS query_genome, b.genome AS target_genome, a.taxon AS query_taxon, b.taxon AS target_taxon, kind, least(a.taxon, b.taxon) || '-' || greatest(a.taxon, b.taxon) AS taxon_pair
FROM hits JOIN w a ON query = a.name JOIN w b ON target = b.name"""
_JOB1 = f"""WITH RECURSIVE {_HITS},
e AS MATERIALIZED (SELECT query AS a, target AS b FROM hits UNION ALL SELECT target, query FROM hits),
reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
lab AS MATERIALIZED (SELECT a AS protein_id, min(b) AS part FROM reach GROUP BY a),
mem AS MATERIALIZED (SELECT protein_id, 'CHG_' || CAST(dense_rank() OVER (ORDER BY part) AS VARCHAR) AS chg_id, genome, taxon FROM lab JOIN w ON protein_id = name),
siz AS MATERIALIZED (SELECT chg_id, count(*) AS n_proteins, count(DISTINCT genome) AS n_genomes, count(DISTINCT taxon) AS n_taxa FROM mem GROUP BY chg_id HAVING count(DISTINCT genome) >= 2),
edg AS MATERIALIZED (SELECT chg_id, genome, count(*) AS weight FROM mem GROUP BY chg_id, genome),
links AS (SELECT a.name AS query, b.name AS target, pident FROM near JOIN named a ON query = a.rep JOIN named b ON target = b.rep
  UNION ALL SELECT a.name, b.name, CAST(100 AS DOUBLE) FROM named a JOIN named b ON a.rep = b.rep AND a.name < b.name),
tr AS MATERIALIZED (SELECT a.chg_id, count(DISTINCT least(a.taxon, b.taxon) || '-' || greatest(a.taxon, b.taxon)) AS taxon_pairs, round(max(pident), 6) AS best_pident
  FROM links JOIN mem a ON query = a.protein_id JOIN mem b ON target = b.protein_id WHERE a.genome <> b.genome GROUP BY a.chg_id)
SELECT protein_id, mem.chg_id, mem.genome, taxon, n_proteins, n_genomes, n_taxa, weight, coalesce(taxon_pairs, 0) AS taxon_pairs, best_pident
FROM mem JOIN siz ON mem.chg_id = siz.chg_id JOIN edg ON mem.chg_id = edg.chg_id AND mem.genome = edg.genome LEFT JOIN tr ON mem.chg_id = tr.chg_id"""


def oracle_sql() -> dict[str, str]:
    return {"job1_shared_clusters": _JOB1, "job2_new_hits": _JOB2}
