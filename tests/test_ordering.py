"""Numbers and running sums over ranges: equal values, order, few rows and many."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import ordering, stats


def test_equal_values_are_split_evenly(spark):
    """Ten million rows of one value: no range holds over twice the mean, and numbers are 1..n."""
    n = 10_000_000
    rows = spark.range(n, numPartitions=16).select(F.lit(7.0).alias("x"))
    d, parts = ordering.ranged(rows, "x", 500_000)
    sizes = [r["count"] for r in d.groupBy("_p").count().collect()]
    assert parts == 20 and sum(sizes) == n and max(sizes) <= 2 * n / parts
    got = ordering.numbered(rows, "x", "i", 500_000).agg(F.min("i"), F.max("i"), F.sum("i"), F.countDistinct("i")).first()
    assert tuple(got) == (1, n, n * (n + 1) // 2, n)


@pytest.mark.parametrize("rows_per_range", [7, 10_000])
def test_numbers_follow_the_order(spark, rows_per_range):
    rng = random.Random(2)
    values = [rng.choice([None, 0.5, 0.5, 0.5, rng.random(), -3.0]) for _ in range(500)]
    df = spark.createDataFrame([(k, v, "clash") for k, v in enumerate(values)], "k int, x double, name string")
    got = sorted(ordering.numbered(df, "x", "i", rows_per_range).collect(), key=lambda r: r["i"])
    assert [r["i"] for r in got] == list(range(1, 501)) and sorted(r["k"] for r in got) == list(range(500))
    key = lambda v: (v is not None, v or 0.0)
    assert [r["x"] for r in got] == sorted(values, key=key)
    counts = df.where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    upto = {r["x"]: r["upto"] for r in ordering.cumulative(counts, "x", rows_per_range=rows_per_range).collect()}
    known = [v for v in values if v is not None]
    assert upto == {v: sum(w <= v for w in known) for v in known}
    assert ordering.numbered(df.where("false"), "x", "i").count() == 0 and ordering.cumulative(counts.where("false"), "x").count() == 0


def test_quantiles_of_many_ties(spark):
    rng = random.Random(3)
    values = [rng.choice([1.0, 1.0, 1.0, 2.5, rng.gauss(0, 3)]) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "HGT_score double")
    n, q = stats.quantiles(stats.valid(df), (0.0, 0.05, 0.5, 0.77, 0.95, 1.0))
    assert n == 4000
    for at, v in q.items():
        assert v == pytest.approx(np.quantile(values, at), abs=1e-12)
    one = stats.describe(df).first()
    assert one["median"] == pytest.approx(np.median(values)) and one["q99"] == pytest.approx(np.quantile(values, 0.99))
    cdf = {r["x"]: r["cdf"] for r in stats.empirical_cdf(df).collect()}
    assert cdf[1.0] == pytest.approx(np.mean(np.array(values) <= 1.0)) and max(cdf.values()) == 1.0
    assert stats.quantiles(stats.valid(df.where("false")), (0.5,)) == (0, {})


def plain_gamma(x):
    """Golden section over the logarithm of the gap below the least value; Newton for the shape."""
    import math

    x = np.array(x)

    def value(t):
        y = x - x.min() + math.exp(t)
        m, ln = y.mean(), np.log(y).mean()
        k = stats._gamma_shape(math.log(m) - ln)
        return (k - 1) * ln - k - k * math.log(m / k) - math.lgamma(k), k, m / k

    at = np.linspace(math.log(1e-6 * np.ptp(x)), math.log(1e3 * np.ptp(x)), 400)
    v = [value(t)[0] for t in at]
    k = max((k for k in range(1, 399) if v[k] >= v[k - 1] and v[k] > v[k + 1] and value(at[k])[1] > 1), key=lambda k: v[k])
    a, b, g = at[k - 1], at[k + 1], (math.sqrt(5) - 1) / 2
    for _ in range(80):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if value(c)[0] > value(d)[0] else (c, b)
    _, shape, scale = value(a)
    return shape, x.min() - math.exp(a), scale


@pytest.mark.parametrize("shape, location", [(2.5, 4.0), (6.0, 0.5), (1.6, 30.0)])
def test_gamma_of_three_parameters(spark, shape, location):
    x = location + np.random.default_rng(5).gamma(shape, 2.0, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "HGT_score double")
    fit = {r["name"]: r for r in stats.fit_distributions(df).collect()}["gamma"]
    assert fit["params"] == pytest.approx(plain_gamma(x), rel=1e-4)
    at = np.sort(x)
    cdf = stats.distribution_cdf("gamma", tuple(fit["params"]), at)
    n = len(x)
    assert fit["ks"] == pytest.approx(max(np.max(np.arange(1, n + 1) / n - cdf), np.max(cdf - np.arange(n) / n)), abs=1e-9) and fit["ks"] < 0.03


def test_gamma_without_an_inner_maximum(spark):
    one = spark.createDataFrame([(3.0,)] * 5, "HGT_score double")
    assert "gamma" not in {r["name"] for r in stats.fit_distributions(one).collect()}
    falling = spark.createDataFrame([(float(v),) for v in 100 - np.random.default_rng(2).exponential(4, 500)], "HGT_score double")
    assert {r["name"]: r["params"] for r in stats.fit_distributions(falling).collect()}["gamma"][1] == 0.0
