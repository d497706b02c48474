"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

#: A key of more than 1 / so many of all rows is heavy; there are fewer than so many of them.
HEAVY = 1000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], total: int, count: str = "c") -> DataFrame:
    """rows joined with a table of one row for each key, which counts the key's rows in ``count``; total: the number of rows.

    Rows of heavy keys, fewer than ``HEAVY`` of them by their counts, meet a broadcast
    table and stay where they are; all others are shuffled, no key with more than a
    ``HEAVY``-th of the rows.
    """
    heavy = F.broadcast(keys.where(F.col(count) > total // HEAVY).drop(count))
    rest = rows.join(heavy.select(*on), on, "left_anti").join(keys.where(F.col(count) <= total // HEAVY).drop(count), on)
    return rows.join(heavy, on).unionByName(rest)


#: Tables of one row for each key that are sent to all tasks: their keys may be so few that a shuffle by them would give one task most rows.
SMALL_ROWS = 200_000


def join_lookup(rows: DataFrame, table: DataFrame, on: str, how: str = "inner", most: int = SMALL_ROWS) -> DataFrame:
    """rows joined with a table of one row for each key, which is broadcast up to ``most`` rows; larger ones are shuffled."""
    table = materialize(table, "lookup")
    return rows.join(F.broadcast(table) if table.count() <= most else table, on, how)


def self_pairs(rows: DataFrame, on: list[str], name: str, keep: tuple[str, ...] = (), block_rows: int = 2000) -> DataFrame:
    """Pairs of rows that agree in ``on`` and differ in ``name``, each unordered pair of rows once: on, name_a < name_b, kept columns of both.

    A key of many rows is cut into blocks of about ``block_rows`` rows by a hash of the name, and
    each pair of blocks, i <= j, is a task's key of its own, so that no task gets more
    pairs of one key than two blocks have. A row goes to as many places as its key has blocks; rows of
    other keys go to one.
    """
    heavy = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows).select(*on, F.ceil(F.col("_n") / block_rows).cast("int").alias("_nb"))
    d = rows.select(*on, name, *keep).join(heavy, on, "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
    d = d.withColumn("_own", F.pmod(F.xxhash64(name), F.col("_nb")).cast("int"))

    def side(mark: str, i: object, j: object) -> DataFrame:
        columns = [F.col(c).alias(f"{c}_{mark}") for c in (name, *keep)]
        return d.select(*on, *columns, F.explode(F.transform(F.sequence(i, j), lambda k: F.struct(*((F.col("_own").alias("_i"), k.alias("_j")) if mark == "a" else (k.alias("_i"), F.col("_own").alias("_j")))))).alias("_b")).select(*on, *[f"{c}_{mark}" for c in (name, *keep)], "_b._i", "_b._j")

    pairs = side("a", F.col("_own"), F.col("_nb") - 1).join(side("b", F.lit(0), F.col("_own")), [*on, "_i", "_j"])
    a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
    pairs = pairs.where(F.when(F.col("_i") == F.col("_j"), a < b).otherwise(a != b))
    swap = a > b
    both = [c for c in (name, *keep)]
    first = [F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a") for c in both]
    second = [F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b") for c in both]
    return pairs.select(*on, *first, *second)
