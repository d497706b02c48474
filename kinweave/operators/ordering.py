"""Numbers and running sums in a global order, by ranges whose number follows the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import drop_scratch, materialize

#: Rows that one task orders.
ROWS_PER_RANGE = 200_000


def ranged(rows: DataFrame, order: str, rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, int]:
    """(rows with _r, a number of their own, and _p, the range of (order, _r) they are in; the number of ranges), materialized.

    _r is written down before ranges are drawn, so it parts any number of equal rows, and
    a task that runs again sends each row to the same range.
    """
    d = materialize(rows.withColumn("_r", F.monotonically_increasing_id()), "numbers")
    parts = -(-d.count() // rows_per_range)
    if parts < 2:
        return d.withColumn("_p", F.lit(0)), 1
    out = materialize(d.repartitionByRange(parts, order, "_r").withColumn("_p", F.spark_partition_id()), "ranges")
    drop_scratch(d)
    return out, parts


def _running(d: DataFrame, parts: int, order: list[str], inside, total) -> DataFrame:
    """d with the columns that ``inside(window)`` makes in each range, raised by ``total`` of the ranges before."""
    window = (Window.partitionBy("_p") if parts > 1 else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if parts < 2:
        return d.withColumn("_upto", inside.over(window))
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)  # over the ranges
    sizes = d.groupBy("_p").agg(total.alias("_c")).select("_p", (F.sum("_c").over(upto) - F.col("_c")).alias("_base"))
    return d.join(F.broadcast(sizes), "_p").withColumn("_upto", F.col("_base") + inside.over(window)).drop("_base")


def numbered(rows: DataFrame, order: str, name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """rows with 1..n in order; no task sees all rows, nor all rows of one value."""
    d, parts = ranged(rows, order, rows_per_range)
    out = _running(d, parts, [order, "_r"], F.count("*"), F.count("*"))
    return out.withColumnRenamed("_upto", name).drop("_r", "_p")


def cumulative(counts: DataFrame, order: str, n: str = "n", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """counts with ``upto``: n of all rows up to this one in order; counts: one row for each value."""
    d, parts = ranged(counts, order, rows_per_range)
    return _running(d, parts, [order], F.sum(n), F.sum(n)).withColumnRenamed("_upto", "upto").drop("_r", "_p")
