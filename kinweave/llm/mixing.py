"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's exponential key is -ln(u) / weight, with u from the MD5 sum of its
id and text, so that reruns, and other engines, agree. Within a source, documents stand by ascending key;
complete epochs come first, and the rest of the target is a prefix of that order.

The prefix ends at one key for each source. It is found without sorting a source
in one task: keys fall into bins, bins are summed before the shuffle, and running
sums over bins show the bin where the target falls. That bin is parted again into
bins between its own least and greatest key, as often as it takes to hold few rows
for any weights; only then it is sorted. Documents are then compared with their
source's cut: the text is never shuffled.

Defined results: a null text has size 0; a null source is a source of its own, the
last; documents of size 0 take nothing; rows that repeat an id and text share a
key and are taken together; rows without an id are told apart by their texts; other
columns stay as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Up to so many sources, their table (some 100 bytes a row) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: A bin of so many rows or fewer is sorted in one task.
SORTED_ROWS = 20_000
#: Source weights in order of name, repeating.
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: falls with the share of characters that are neither letters nor white space."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\s]++", "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 2 * odd), F.lit(0.05))


def keyed(docs: DataFrame, seed: int = 10, weight: Column | None = None) -> DataFrame:
    """docs and _size, _hash, _key."""
    text = F.col("text")
    label = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(text, F.lit("")))
    u = (F.conv(F.substring(F.md5(label), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    docs = docs.withColumns({"_size": word_count(text), "_hash": F.xxhash64(text), "_weight": quality_weight(text) if weight is None else weight})
    return docs.withColumn("_key", -F.log(u) / F.col("_weight")).drop("_weight")


def _by_source(rows: DataFrame, own: DataFrame, n: int, on: Column | None = None, how: str = "inner") -> DataFrame:
    """rows joined with a table of at most one row for each of n sources."""
    own = own.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    own = F.broadcast(own) if n <= BROADCAST_SOURCES else own
    return rows.join(own, same if on is None else same & on, how).drop("_source")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, docs) -> and target, capped. Weighted shares of all sizes, water-filled up to the cap.

    One row for each source; the window over all of them is over sources, not documents.
    """
    name = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("rank", F.row_number().over(name) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", MOST_EPOCHS * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("left", F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("w").over(after)).withColumn("at", F.row_number().over(order))
    s = s.withColumn("first", F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("at"))).over(every))
    s = s.withColumn("level", F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(every))
    capped = F.col("first").isNull() | (F.col("at") < F.col("first"))
    return s.select("source", "source_size", "docs", F.when(capped, F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"), capped.alias("capped"))


def mixing_plan(rows: DataFrame) -> DataFrame:
    """One row for each source: source, source_size, target, epochs, and the cut: the last (key, id, hash) of the fractional epoch, or null.

    rows: (doc_id, source, _size, _hash, _key), materialized.
    """
    sizes = rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("docs"))
    plan = targets(sizes)
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).when(F.col("capped"), F.lit(MOST_EPOCHS)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("int")
    plan = plan.withColumn("epochs", epochs)
    plan = plan.withColumn("rest", F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = materialize(plan, "mix")
    n, largest = plan.agg(F.count("*"), F.max("docs")).first()
    bins = 256
    while bins * SORTED_ROWS < (largest or 0) and bins < 1 << 16:
        bins *= 2
    rows = rows.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("_key"))) * bins), F.lit(bins - 1)).cast("int"))
    need = plan.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("base"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        sums = rows.groupBy("source", "bin").agg(F.sum("_size").alias("bin_size"), F.count("*").alias("bin_rows"))
        cross = _by_source(sums.withColumn("upto", F.sum("bin_size").over(running)), need, n).withColumn("upto", F.col("upto") + F.col("base"))
        cross = cross.where("upto >= rest and upto - bin_size < rest").select("source", F.col("bin").alias("_bin"), "rest", (F.col("upto") - F.col("bin_size")).alias("base"), "bin_rows")
        cross = materialize(cross, "cross")
        most = cross.agg(F.max("bin_rows")).first()[0] or 0
        inside = _by_source(rows, cross, n, F.col("bin") == F.col("_bin")).select("source", "_key", "doc_id", "_hash", "_size", "rest", "base")
        if most <= SORTED_ROWS:
            break
        inside = materialize(inside, "inside")
        spans = materialize(inside.groupBy("source").agg(F.min("_key").alias("low"), F.max("_key").alias("high")), "spans")
        if not spans.where("high > low").limit(1).count():
            break  # nothing but ties
        rows = _by_source(inside.drop("rest", "base"), spans, n)
        rows = rows.withColumn("bin", F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("_key") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")).drop("low", "high")
        need = cross.select("source", "rest", "base")
    # rows that repeat an id and text are one
    inside = inside.groupBy("source", "_key", "doc_id", "_hash", "rest", "base").agg(F.sum("_size").alias("_size"))
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "_hash")
    inside = inside.withColumn("upto", F.col("base") + F.sum("_size").over(order))  # a range frame: equal rows come together
    taken = (F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("_size") < F.col("rest")) & (F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("_size"))))
    # the whole bins before the crossing one are taken even where none of its documents is
    cuts = inside.groupBy("source").agg(F.max(F.when(taken, F.struct("_key", "doc_id", "_hash"))).alias("cut"), F.min(F.struct("_key", "doc_id", "_hash")).alias("low"))
    return _by_source(plan, cuts, n, how="left").select("source", "source_size", "target", "epochs", F.col("cut"), F.when(F.col("cut").isNull(), F.col("low")).alias("below"))


def decide(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source_size, target, and _times: how often the mix takes the document."""
    me = F.struct("_key", "doc_id", "_hash")
    joined = _by_source(rows, plan, plan.count(), how="left")
    extra = F.coalesce(me <= F.col("cut"), me < F.col("below"), F.lit(False))
    return joined.withColumn("_times", F.col("epochs") + extra.cast("int")).drop("cut", "below", "epochs")


def mix(docs: DataFrame, seed: int = 10) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken."""
    rows = materialize(keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), "keys")
    d = decide(rows, materialize(mixing_plan(rows), "plan"))
    return d.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_times") * F.col("_size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 10) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them; columns as before."""
    rows = keyed(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text"), seed).drop("text")
    plan = materialize(mixing_plan(materialize(rows.select("doc_id", "source", "_size", "_hash", "_key"), "keys")), "plan")
    taken = decide(rows, plan).where("_times > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
