"""Spans of a pattern in a text as Spark expressions, without Python on the executors.

``split`` and ``regexp_extract_all`` walk the same matches, so the lengths of the
pieces between them give every match's place in code points.

An expression that a lambda mentions is computed anew for each element, a column of
an earlier projection too, since the optimizer writes it in its place. ``bound`` makes
it the variable of a lambda of its own, which is computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once, however often f's lambdas mention it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(items: Column) -> Column:
    """The array in pieces of ``_BLOCK``; items: bound."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(_BLOCK))
    return F.transform(starts, lambda s: F.slice(items, s + 1, F.lit(_BLOCK)))


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array<int>: of whole blocks first, then in each block."""
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def of_blocks(blocks: Column) -> Column:
        inside = lambda sums: F.transform(
            blocks, lambda own, k: bound(add(F.slice(sums, F.lit(1), k)), lambda base: F.transform(own, lambda v, i: base + add(F.slice(own, F.lit(1), i + 1))))
        )
        return F.flatten(bound(F.transform(blocks, add), inside))

    return bound(numbers, lambda n: bound(_blocks(n), of_blocks))


def matches(text: Column, pattern: str, when: Column) -> Column:
    """All leftmost non-overlapping matches; an empty array where ``when`` is false."""
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def pieces(text: Column, pattern: str, found: Column) -> Column:
    """The texts before each match, and after the last."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def placed(found: Column, between: Column, context: int = 40) -> Column:
    """array<struct<start,end,text,before>>: code points, end exclusive; before: up to ``context`` code points since the match before."""

    def of(m: Column, gaps: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda p, x: F.length(p) + F.length(x))
        ends = F.when(F.size(m) > 0, running_sums(lengths)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            F.arrays_zip(m.alias("m"), ends.alias("e"), F.slice(gaps, F.lit(1), F.size(m)).alias("p")),
            lambda z: F.struct((z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), z["m"].alias("text"), F.substring(z["p"], -context, context).alias("before")),
        )

    return bound(found, lambda m: bound(between, lambda gaps: of(m, gaps)))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others; each meets the blocks of others by place, and only the spans of a block it touches."""

    def of(blocks: Column) -> Column:
        meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
        return F.filter(spans, lambda s: ~F.exists(blocks, lambda b: meet(s, b) & F.exists(b["own"], lambda x: meet(s, x))))

    edges = lambda own: F.struct(F.array_min(F.transform(own, lambda x: x["start"])).alias("start"), F.array_max(F.transform(own, lambda x: x["end"])).alias("end"), own.alias("own"))
    return F.when(F.size(others) > 0, bound(bound(F.sort_array(others), lambda o: F.transform(_blocks(o), edges)), of)).otherwise(spans)
