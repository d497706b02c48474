"""Job 2, a stream: keeps the similarity hits of a growing folder of records up to date.

    python -m jobs.new_hits RECORDS OUTPUT CHECKPOINT [--config jobs/new_hits.json] [--min_pident 80]

Who adds records to a collection does not want to search all against all again. A run
takes the files that are new in RECORDS (a file stream with a checkpoint), compares their
records with each other and with all earlier ones, and ends. OUTPUT then holds

- ``index``, by batch: one row for each distinct set of word runs, with its first record;
- ``hits``, by batch and taxon pair: (query, target, pident, genomes, taxa, kind), query
  before target. ``kind`` is ``near`` for two different sets of at least ``min_pident``
  per cent Jaccard similarity, ``copy`` for a record whose set an earlier record has: its
  other hits are those of that record, so that copies need no pairs among themselves;
- ``order``, of the first batch: the frequent word runs, which are compared last ever after.

A batch writes its own partitions only, and reads those before it, so a batch that is
run again after a failure gives the same files. Records whose id is in the index, or
among its copies, are not new. Records without an id or with fewer words than a run are
skipped and logged; of a batch's rows with one id the least text counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import exit_with, log, main, one_of_each
from kinweave.functions.scalars import pair_label
from kinweave.operators.joins import join_counted, join_lookup
from kinweave.operators.similarity import SMALL_NAMES, distinct_sets, frequent_features, frequent_last, hashed_sets, linked_sets
from kinweave.runtime import drop_scratch, materialize

INDEX = "name string, genome string, taxon string, size int, s array<bigint>, k1 bigint, k2 bigint, batch bigint"
HITS = "query string, target string, pident double, query_genome string, target_genome string, query_taxon string, target_taxon string, kind string, batch bigint, taxon_pair string"
ORDER = "h bigint, df bigint"


@dataclass(frozen=True)
class Config:
    min_pident: float = 80.0
    words: int = 5
    id_column: str = "doc_id"
    text_column: str = "text"
    genome_column: str = "source"
    taxon_column: str = "lang"
    #: a word run in more than this share of the first batch's records is frequent
    common_share: float = 0.001
    files_per_batch: int = 1000


def _write(df: DataFrame, path: str, batch: int, by: list[str]) -> None:
    """The batch's partitions. The first batch of a checkpoint replaces what an older one left."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if batch else "static").partitionBy(*by).parquet(path)


def _new_records(rows: DataFrame, config: Config, seen: DataFrame | None) -> DataFrame:
    """(name, text, genome, taxon) of records that have an id and are not indexed yet."""
    own = F.struct(F.col(config.text_column).alias("text"), F.col(config.genome_column).cast("string").alias("genome"), F.col(config.taxon_column).cast("string").alias("taxon"))
    d = one_of_each(rows.where(F.col(config.id_column).isNotNull()), F.col(config.id_column).cast("string"), own)
    if seen is None:
        return d
    known = materialize(d.select("name").join(seen, "name", "left_semi"), "seen")  # names only
    return join_lookup(d, known, "name", "left_anti", SMALL_NAMES)


def take(rows: DataFrame, batch: int, output: str, config: Config) -> int:
    """One batch: indexes the new records and writes their hits. Returns the number of rows it read."""
    spark = rows.sparkSession
    earlier = F.col("batch") < batch
    index = spark.read.schema(INDEX).parquet(f"{output}/index").where(earlier) if batch else None
    seen = None
    if index is not None:
        copies = spark.read.schema(HITS).parquet(f"{output}/hits").where(earlier & (F.col("kind") == "copy"))
        seen = index.select("name").unionByName(copies.select(F.explode(F.array("query", "target")).alias("name")))
    records = _new_records(rows, config, seen)
    attributes = materialize(records.select("name", "genome", "taxon"), "records")
    hashed = materialize(hashed_sets(records, "name", "text", config.words, ("genome", "taxon")), "hashed")
    if not batch:
        frequent_features(hashed, max(1.0, config.common_share * attributes.count())).write.mode("overwrite").parquet(f"{output}/order")
    sets = frequent_last(hashed, spark.read.schema(ORDER).parquet(f"{output}/order"))
    own, copied = distinct_sets(sets)
    if index is not None:  # a set that an earlier record has: its record, and all copies of it, are copies of that one
        known = own.select("name", "k1", "k2").join(index.select(F.col("name").alias("first"), "k1", "k2"), ["k1", "k2"])
        known = materialize(known.select("name", "first"), "known")
        many = materialize(copied.groupBy("copy_of").agg(F.count("*").alias("c")), "many")
        moved = known.select(F.col("name").alias("copy_of"), "first").join(many, "copy_of")
        left = many.join(known.select(F.col("name").alias("copy_of")), "copy_of", "left_anti").select("copy_of", F.col("copy_of").alias("first"), "c")
        total = hashed.count()
        copied = join_counted(copied, moved.unionByName(left), ["copy_of"], total).select("name", F.col("first").alias("copy_of"))
        copied = copied.unionByName(known.select("name", F.col("first").alias("copy_of")))
        own = own.join(known.select("name"), "name", "left_anti")
    _write(own.select("name", "genome", "taxon", "size", "s", "k1", "k2").withColumn("batch", F.lit(batch).cast("long")), f"{output}/index", batch, ["batch"])
    every = spark.read.schema(INDEX).parquet(f"{output}/index")
    new = every.where(F.col("batch") == batch)
    near = linked_sets(new, new, config.min_pident, same=True)
    if batch:
        near = near.unionByName(linked_sets(new, every.where(earlier), config.min_pident))
    hits = near.withColumn("kind", F.lit("near")).unionByName(copied.select(F.col("copy_of").alias("query"), F.col("name").alias("target"), F.lit(100.0).alias("pident"), F.lit("copy").alias("kind")))
    hits = hits.select(F.least("query", "target").alias("query"), F.greatest("query", "target").alias("target"), "pident", "kind")
    known_by = attributes if not batch else attributes.unionByName(every.where(earlier).select("name", "genome", "taxon"))
    for side in ("query", "target"):
        hits = hits.join(known_by.toDF(side, f"{side}_genome", f"{side}_taxon"), side)
    hits = hits.select("*", F.lit(batch).cast("long").alias("batch"), pair_label(F.col("query_taxon"), F.col("target_taxon")).alias("taxon_pair"))
    hits = materialize(hits, "hits")
    _write(hits, f"{output}/hits", batch, ["batch", "taxon_pair"])
    read = rows.count()
    log.info("batch %d: read %d rows, %d new records, %d distinct sets; wrote %d hits to %s/hits", batch, read, attributes.count(), new.count(), hits.count(), output)
    drop_scratch(attributes, hashed, hits)
    return read


def run(spark: SparkSession, records: str, output: str, checkpoint: str, config: Config = Config()) -> int:
    """Takes what is new in the folder and returns the number of rows it read."""
    log.info("reading new files of %s, checkpoint %s", records, checkpoint)
    id_kind = spark.read.parquet(records).schema[config.id_column].dataType.simpleString()
    schema = f"`{config.id_column}` {id_kind}, `{config.text_column}` string, `{config.genome_column}` string, `{config.taxon_column}` string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(records)
    read: list[int] = []  # by batch: foreachBatch runs here, on the driver
    query = stream.writeStream.foreachBatch(lambda rows, batch: read.append(take(rows, batch, output, config))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows in %d batches", sum(read), len(read))
    return sum(read)


def hits(spark: SparkSession, output: str) -> DataFrame:
    """All hits as they stand."""
    return spark.read.schema(HITS).parquet(f"{output}/hits")


if __name__ == "__main__":
    exit_with(main("new hits of a growing collection", Config, Path(__file__).with_suffix(".json"), {"records": "folder of Parquet files", "output": "folder of index and hits", "checkpoint": "folder of the stream's checkpoint"}, run))
