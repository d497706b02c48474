"""Fetching a dataset through an archive client: resolve, look into the cache, fetch, parse, save, count.

The whole dataset moves as DataFrames: a record is a row, and each step joins what
the client, the cache or the parser has for it. Nothing is looped over on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_filename
from ..runtime import materialize
from . import files, sinks
from .remote import ArchiveClient

SUCCESS, CACHED, DUPLICATE, FAILED = "success", "cached", "duplicate", "failed"


@dataclass(frozen=True)
class DatasetConfig:
    """name: the category; columns: where a record's fields stand in the source table."""

    name: str
    columns: dict[str, str] = field(default_factory=dict)
    fetch_proteins: bool = True
    fetch_genes: bool = True
    combine_chromosomes: bool = False
    validate_counts: bool = False

    @classmethod
    def preset(cls, name: str) -> DatasetConfig:
        """One of the four bundled kinds; organisms with several chromosomes are only combined where chromosomes are listed."""
        whole = name in ("archaea", "bacteria")
        return cls(name, files.PRESETS[name], combine_chromosomes=whole, validate_counts=whole)


def search_terms(records: DataFrame) -> DataFrame:
    """(uniq_id, query_rank, term) of records whose primary accession is a project: by project first, then by organism."""
    primary, organism = F.col("accessions")[0], F.col("organism")
    project_id = F.coalesce(F.try_element_at("additional", F.lit("BioProject ID")), primary)
    project = F.concat(F.lit("("), primary, F.lit("[BioProject] OR "), project_id, F.lit("[BioProject ID])"))
    named = F.concat(F.lit('"'), organism, F.lit('"[Organism]'))
    # The filters of the archive's query language, narrow ones first.
    by_project = (" AND (complete genome[filter] OR complete sequence[filter]) AND refseq[filter]", " AND (complete genome[filter] OR complete sequence[filter])", "")
    by_name = (" AND (complete genome[title] OR complete sequence[title]) AND refseq[filter]", " AND (complete genome[title] OR complete sequence[title])", " AND refseq[filter]", "")
    terms = [F.concat(project, F.lit(x)) for x in by_project] + [F.when(organism != "", F.concat(named, F.lit(x))) for x in by_name]
    d = records.where(F.startswith(primary, F.lit("PRJ"))).select("uniq_id", F.posexplode(F.array(*terms)).alias("query_rank", "term"))
    return d.where("term is not null")


def resolve(records: DataFrame, client: ArchiveClient) -> DataFrame:
    """records with resolved (array): a project's first hit in order of the queries, else the record's own accessions; null if there is none."""
    terms = search_terms(records)
    hits = files.first_hit(terms.join(client.search(terms.select("term")), "term")).select("uniq_id", F.col("accession").alias("_hit"))
    own = F.when(~F.startswith(F.col("accessions")[0], F.lit("PRJ")), F.col("accessions"))
    return records.join(hits, "uniq_id", "left").withColumn("resolved", F.coalesce(own, F.when(F.col("_hit").isNotNull(), F.array("_hit")))).drop("_hit")


def first_of_accession(rows: DataFrame, accession: str = "accession", order: str = "line", owner: str = "uniq_id") -> DataFrame:
    """rows with previous: the owner of the first row of the same accession, null on that row itself and where the accession is null."""
    first = rows.where(F.col(accession).isNotNull()).groupBy(accession).agg(F.min(F.struct(F.col(order).alias("o"), F.col(owner).alias("u"))).alias("_first"))
    is_first = F.struct(F.col(order).alias("o"), F.col(owner).alias("u")) == F.col("_first")
    return rows.join(first, accession, "left").withColumn("previous", F.when(~is_first, F.col("_first.u"))).drop("_first")


def result_rows(results: DataFrame) -> DataFrame:
    """One row for each result, for export: the record's extras, UniqID, organism, taxid, and what happened in columns that begin with an underscore."""
    extra = lambda k, c: F.coalesce(F.try_element_at("additional", F.lit(k)), F.col(c)).alias(k)
    listed = lambda c: F.array_join(c, ",")
    path = lambda suffix: F.when(F.col("status") == SUCCESS, F.concat(F.lit(f"{suffix}/"), safe_filename(F.col("accession"))))
    return results.select(
        "additional", F.col("uniq_id").alias("UniqID"), extra("Organism/Name", "organism"), extra("TaxID", "taxid"), F.col("category").alias("_category"), listed("accessions").alias("_original_accessions"),
        F.col("status").alias("_status"), F.col("error").alias("_error"), F.col("sequence_length").alias("_sequence_length"), path("fasta").alias("_fasta_file"), path("genbank").alias("_genbank_file"),
        F.when(F.col("n_proteins") > 0, path("proteins")).alias("_protein_file"), F.when(F.col("n_genes") > 0, path("genes")).alias("_gene_file"), listed("resolved").alias("_resolved_accessions"),
    )


def counters(results: DataFrame) -> DataFrame:
    """One row: total, succeeded (cached ones included), cached, duplicates, failed, genes and proteins."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return results.agg(
        F.count("*").alias("total"), of(SUCCESS, CACHED).alias("succeeded"), of(CACHED).alias("cached"), of(DUPLICATE).alias("duplicates"), of(FAILED).alias("failed"),
        F.coalesce(F.sum("n_genes"), F.lit(0)).alias("genes"), F.coalesce(F.sum("n_proteins"), F.lit(0)).alias("proteins"),
    )


def protein_totals(proteins: DataFrame) -> DataFrame:
    """One row: proteins and genomes of merged protein files; proteins: (protein_id, genome_accession, ...)."""
    return proteins.agg(F.count("*").alias("total_proteins"), F.countDistinct("genome_accession").alias("total_genomes"))


class Fetcher:
    """Wires a client, a storage folder and the cache that the folder is.

    ``fetch_dataset`` returns one row for each record: the record's columns, line,
    resolved, accession, status, error, sequence_length, n_genes, n_proteins, expected
    and ok (counts within the tolerance, null without an expectation).
    """

    def __init__(self, client: ArchiveClient, root: str, use_cache: bool = True) -> None:
        self.client, self.root, self.use_cache = client, root.rstrip("/"), use_cache

    def folder(self, kind: str, category: str) -> str:
        return f"{self.root}/{kind}/{category}"

    def cached(self, spark: SparkSession, config: DatasetConfig) -> DataFrame:
        """(accession) of documents in the folder of fetched records; empty where there is none."""
        path = self.folder("genbank", config.name)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not self.use_cache or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], "accession string")
        return spark.read.schema("accession string").parquet(path).distinct()

    def parsed(self, accessions: DataFrame) -> DataFrame:
        """Records of the flat files the client has: (asked, body, and the columns of files.GENBANK)."""
        bodies = self.client.fetch_sequences(accessions, "gb").select("accession", "body")

        def run(batches):
            import pyarrow as pa

            kv = pa.map_(pa.string(), pa.string())
            feature = pa.list_(pa.struct([("kind", pa.string()), ("location", pa.string()), ("qualifiers", kv)]))
            kind = pa.schema([("asked", pa.string()), ("body", pa.string()), ("accession", pa.string()), ("definition", pa.string()), ("organism", pa.string()), ("lineage", pa.list_(pa.string())), ("xrefs", pa.list_(pa.string())), ("features", feature), ("sequence", pa.string())])
            for batch in batches:
                rows = []
                for asked, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        r = files.parse_genbank(body or "")[0]
                    except ValueError:
                        r = {}
                    if not r.get("accession"):
                        continue  # not a record: what was asked for counts as failed
                    for f in r["features"]:
                        f["qualifiers"] = list(f["qualifiers"].items())
                    rows.append(r | {"asked": asked, "body": body})
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

        return bodies.mapInArrow(run, "asked string, body string, " + files.GENBANK)

    def fetch_dataset(self, records: DataFrame, config: DatasetConfig, max_records: int | None = None) -> DataFrame:
        """records: (line, uniq_id, organism, taxid, category, accessions, additional)."""
        spark = records.sparkSession
        records = records if max_records is None else records.orderBy("line").limit(max_records)
        d = resolve(materialize(records, "records"), self.client)
        parts = F.col("resolved") if config.combine_chromosomes else F.slice("resolved", 1, 1)
        d = materialize(d.withColumn("wanted", F.coalesce(parts, F.array().cast("array<string>"))), "wanted")
        have = self.cached(spark, config).withColumn("_cached", F.lit(True))
        asked = d.select("line", "uniq_id", F.posexplode("wanted").alias("part", "asked"))
        asked = asked.join(have.withColumnRenamed("accession", "asked"), "asked", "left")
        new = asked.where("_cached is null")
        found = materialize(self.parsed(new.select(F.col("asked").alias("accession")).distinct()), "parsed")
        # one row for each record: its first accession names it, its parts' sequences add up
        own = asked.join(found.withColumnRenamed("accession", "refseq"), "asked", "left")
        some = F.exists("features", lambda f: f["kind"] == "gene")
        genes = F.size(F.filter("features", lambda f: f["kind"] == F.when(some, "gene").otherwise("CDS")))
        own = own.groupBy("line", "uniq_id").agg(
            F.min_by(F.coalesce("refseq", "asked"), "part").alias("accession"), F.coalesce(F.min(F.coalesce("_cached", F.lit(False))), F.lit(False)).alias("_cached"), F.coalesce(F.min(F.col("refseq").isNotNull() | F.coalesce("_cached", F.lit(False))), F.lit(False)).alias("_found"),
            F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("sequence_length"), F.coalesce(F.sum(F.when(F.col("features").isNotNull(), genes)), F.lit(0)).alias("n_genes"),
            F.coalesce(F.sum(F.size(F.filter("features", lambda f: f["kind"] == "CDS"))), F.lit(0)).alias("n_proteins"),
        )
        d = first_of_accession(d.join(own, ["line", "uniq_id"], "left"))
        status = F.when(F.col("resolved").isNull(), FAILED).when(F.col("_cached"), CACHED).when(~F.coalesce("_found", F.lit(False)), FAILED).when(F.col("previous").isNotNull(), DUPLICATE).otherwise(SUCCESS)
        error = (
            F.when(F.col("resolved").isNull(), F.concat(F.lit("Could not resolve BioProject "), F.col("accessions")[0])).when(status == DUPLICATE, F.concat(F.lit("Already fetched as "), F.col("previous")))
            .when(status == FAILED, F.concat(F.lit("No record for "), F.col("resolved")[0]))
        )
        d = d.withColumns({"status": status, "error": error})
        counted = lambda c: F.when(F.col("status") == SUCCESS, F.col(c)).otherwise(F.lit(0)).alias(c)
        d = d.select("line", "uniq_id", "organism", "taxid", "category", "accessions", "additional", "resolved", "accession", "status", "error", *[counted(c) for c in ("sequence_length", "n_genes", "n_proteins")])
        expected = F.try_element_at("additional", F.lit("_expected_genes")).try_cast("bigint") if config.validate_counts else F.lit(None).cast("bigint")
        results = materialize(files.count_deviation(d.withColumns({"expected": expected, "found": F.col("n_genes")})).drop("found"), "results")
        self._save(results, found, config)
        return results

    def _save(self, results: DataFrame, found: DataFrame, config: DatasetConfig) -> None:
        """Records, sequences, proteins and genes of what was fetched, and the table of results."""
        kept = results.where(F.col("status") == SUCCESS).select(F.col("accession").alias("_own"), F.posexplode("resolved").alias("_part", "asked"))
        own = found.join(kept.select("asked").distinct(), "asked", "left_semi")
        own.select("accession", "body").write.mode("append").parquet(self.folder("genbank", config.name))
        sinks.write_fasta(own.select(F.lit(config.name).alias("category"), "accession", F.concat_ws(" ", "accession", "definition").alias("description"), "sequence"), f"{self.root}/fasta", "append")
        if config.fetch_proteins:
            files.genbank_proteins(own).write.mode("append").parquet(self.folder("proteins", config.name))
        if config.fetch_genes:
            files.genbank_genes(own).write.mode("append").parquet(self.folder("genes", config.name))
        result_rows(results).write.mode("overwrite").json(self.folder("metadata", config.name))


def fetch_all(fetcher: Fetcher, datasets: dict[str, DataFrame], max_records: int | None = None) -> DataFrame:
    """Counters of each dataset, one row a category; datasets: records by the name of a preset."""
    out = None
    for name, records in datasets.items():
        done = counters(fetcher.fetch_dataset(records, DatasetConfig.preset(name), max_records)).withColumn("category", F.lit(name))
        out = done if out is None else out.unionByName(done)
    if out is None:
        raise ValueError("no dataset is given")
    return out


def numbered_records(records: DataFrame, order: Column | str = "uniq_id") -> DataFrame:
    """records with line, 1 to n in order: record lists are of dimension size."""
    return records.withColumn("line", F.row_number().over(Window.orderBy(order)))
