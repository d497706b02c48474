"""How filters interact: what each one removes, alone, after others, and in every order.

The filters of one text are Spark expressions. Duplicates are found by partition
refinement: texts are split by length in code points, classes then by the hash of
one block of the text after the other (blocks grow fourfold, so a text has few), and
a row whose class has no other row is dropped from every later round. One scan hashes
all blocks, so the rounds read some dozen bytes a row. What is left is compared by
whole texts: an aggregation by text gives the least id, and greater ids are marked.
Then rows are only counted, by part and by the set of filters that they fail; all
orders of the filters follow from these counts.

A class may hold any share of the rows. Classes of over a thousandth of all rows,
so a thousand at most, are joined by broadcast, others by shuffle; copies of a text
meet in an aggregation that reduces before the shuffle. The ids of a text never
stand in one row.

Defined results: a null text is empty, a null source the part of the empty name;
empty texts are copies of each other; rows of one id and text do not fail as
duplicates of each other; a row without an id is above every id, and a duplicate
only of rows with one; a document with several labels has what any of them says;
labels without an id or document count nowhere; other columns are ignored, whatever
their names; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_scratch, materialize

#: The first block of a text in code points; the next ones are four times the one before. A string of 2 GB has 12.
FIRST_BLOCK, GROWTH, BLOCKS = 256, 4, 13
#: Keys of more than 1 / so many of all rows are joined by broadcast: fewer than so many.
HEAVY = 1000
#: Up to so many keys (8 bytes each) a table of keys is broadcast whole.
BROADCAST_KEYS = 200_000

Condition = Callable[[Column, Column], Column]
#: Failure conditions of a text and its words. E, the duplicates, is no condition of one text.
CONDITIONS: dict[str, Condition] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
DUPLICATE = "E"
SPACE = r"[\x20\x09-\x0D]++"


def class_keys(text: Column, block_hash: Callable[[Column], Column] = F.xxhash64) -> Column:
    """array<long>: the length, then for each block a hash of the key before it and the block."""
    ends = [FIRST_BLOCK * (GROWTH**k - 1) // (GROWTH - 1) for k in range(BLOCKS + 1)]
    blocks = F.array(*[F.struct(F.lit(min(a, 2**31 - 1)).alias("a"), F.lit(min(b - a, 2**31 - 1)).alias("n")) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    # the length is bound once: in each block it would be counted anew
    hashes = F.flatten(F.transform(F.array(F.length(text)), lambda n: F.transform(F.filter(blocks, lambda b: b["a"] < n), lambda b: block_hash(F.substring(text, b["a"] + 1, b["n"])))))
    start = F.array(F.length(text).cast("long"))
    return F.aggregate(hashes, start, lambda keys, h: F.concat(keys, F.array(F.xxhash64(F.element_at(keys, -1), h))))


def _whole(text: Column) -> Column:
    return F.xxhash64(F.lit(11), text)


def screened(docs: DataFrame, conditions: dict[str, Condition], block_hash=F.xxhash64) -> DataFrame:
    """(doc_id, part, mask, keys, whole): mask has bit k for the k-th condition, whole is a hash of the text. The one scan that splits texts."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    mask = F.lit(0)
    for k, fails in enumerate(conditions.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0)
    return d.select("doc_id", "part", mask.alias("mask"), class_keys(F.col("text"), block_hash).alias("keys"), _whole(F.col("text")).alias("whole"))


def _semi(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """rows whose key is in counts: (key, c). A heavy key's rows stay where they are."""
    heavy = F.broadcast(counts.where(F.col("c") > total // HEAVY).select("key"))
    light = rows.join(heavy, "key", "left_anti").join(counts.where(F.col("c") <= total // HEAVY).select("key"), "key", "left_semi")
    return rows.join(heavy, "key", "left_semi").unionByName(light)


def shared_classes(rows: DataFrame, total: int) -> DataFrame:
    """(doc_id, whole, key) of the rows that share length and all block hashes with another; rows: (doc_id, whole, keys)."""
    rows = rows.select("doc_id", "whole", "keys")
    k, last = 0, 0
    while k <= last:
        rows = rows.withColumn("key", F.coalesce(F.get("keys", F.lit(k)), F.element_at("keys", -1)))
        counts = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        before, rows = rows, materialize(_semi(rows, counts, total).drop("key"), f"round{k}")
        if k:
            drop_scratch(before)
        else:
            last = rows.agg(F.coalesce(F.max(F.size("keys")), F.lit(0))).first()[0] - 1
        k += 1
    return rows.select("doc_id", "whole", F.element_at("keys", -1).alias("key"))


def duplicate_marks(docs: DataFrame, rows: DataFrame, block_hash=F.xxhash64) -> DataFrame:
    """(doc_id, whole, key), distinct, of the rows that equal a smaller id's text; rows: of ``screened``, materialized."""
    total = rows.count()
    shared = materialize(shared_classes(rows, total), "shared")
    classes = materialize(shared.groupBy("key").agg(F.count("*").alias("c")), "classes")
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.element_at(class_keys(text, block_hash), -1).alias("key"))

    def of(keys: DataFrame) -> DataFrame:
        return whole.join(F.broadcast(keys.select("key")), "key", "left_semi") if keys.count() <= BROADCAST_KEYS else _semi(whole, keys, total)

    least = of(classes).groupBy("key", "text").agg(F.min("doc_id").alias("least"))
    least = materialize(least.groupBy("key").agg(F.count("*").alias("texts"), F.min("least").alias("least")), "least").join(classes, "key")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.col("doc_id").isNull() & F.col("least").isNotNull())
    one = least.where("texts = 1")
    heavy = F.broadcast(one.where(F.col("c") > total // HEAVY).select("key", "least"))
    marks = shared.join(heavy, "key").unionByName(shared.join(heavy, "key", "left_anti").join(one.where(F.col("c") <= total // HEAVY).select("key", "least"), "key"))
    marks = marks.where(later).select("doc_id", "whole", "key")
    clash = least.where("texts > 1")
    if clash.limit(1).count():  # different texts of one key are told apart by themselves
        clashing = of(clash)
        own = clashing.groupBy("key", "text").agg(F.min("doc_id").alias("least"))
        marks = marks.unionByName(clashing.join(own, ["key", "text"]).where(later).select("doc_id", _whole(F.col("text")).alias("whole"), "key"))
    return marks.distinct()


def mask_counts(docs: DataFrame, labels: DataFrame, conditions: dict[str, Condition] = CONDITIONS, block_hash=F.xxhash64) -> DataFrame:
    """(part, mask, n, good, toxic): rows by the set of filters they fail; duplicates are the last bit."""
    rows = materialize(screened(docs, conditions, block_hash), "screened")
    marks = duplicate_marks(docs, rows, block_hash)
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    d = rows.select("doc_id", "part", "mask", "whole", F.element_at("keys", -1).alias("key"))
    marks = marks.select(F.col("doc_id").alias("_mark"), F.col("whole").alias("_whole"), F.col("key").alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_mark")) & (F.col("whole") == F.col("_whole")) & (F.col("key") == F.col("_key"))
    d = d.join(marks, same, "left").join(said, F.col("doc_id") == F.col("_id"), "left")
    d = d.withColumn("mask", F.col("mask") + F.when(F.col("_key").isNotNull(), 1 << len(conditions)).otherwise(0))
    return d.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("_good").alias("good"), F.count_if("_toxic").alias("toxic"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """Every order and step of the filters, by part, from the counts of failed sets; at most 2 ** letters of them a part."""
    if len(letters) > 6:
        raise ValueError("the orders of more than six filters are too many")
    orders = ["".join(p) for p in permutations(letters)]
    every = math.factorial(len(letters))
    d = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))
    d = d.select("part", "sets", F.explode(F.lit(orders)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    bits = F.lit([1 << k for k in range(len(letters))])
    bit = lambda k: F.element_at(bits, F.instr(F.lit(letters), F.substring("filter_order", k, F.lit(1))))
    earlier = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda m, k: m + F.when(k > 0, bit(F.greatest(k, F.lit(1)))).otherwise(0))
    d = d.select("*", bit(F.col("step")).alias("own"), earlier.alias("prior"))
    own, prior = F.col("own"), F.col("prior")
    total = lambda what, when: F.aggregate("sets", F.lit(0).cast("long"), lambda s, x: s + F.when(when(x["mask"]), what(x)).otherwise(F.lit(0)).cast("long"))
    fails, passed = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(prior) == 0)
    removed = lambda m: fails(m) & passed(m)
    return d.select(
        "part", "filter_order", "step",
        total(lambda x: x["n"], lambda m: ~fails(m) & passed(m)).alias("kept"), total(lambda x: x["n"], removed).alias("removed"),
        total(lambda x: x["n"], lambda m: fails(m) & ~passed(m)).alias("redundant"), total(lambda x: x["n"], lambda m: m == own).alias("unique_fails"),
        total(lambda x: x["good"], removed).alias("good_lost"), total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        # of k failed filters each comes first in a k-th of all orders
        total(lambda x: x["n"] * (F.lit(every) / F.greatest(F.bit_count(x["mask"]), F.lit(1))).cast("long"), fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Condition] = CONDITIONS) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(mask_counts(docs, labels, conditions), "".join(conditions) + DUPLICATE)
