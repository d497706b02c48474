"""Descriptive statistics, distribution fits, bootstrap intervals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fit_quality
from ..runtime import drop_scratch, materialize
from .ordering import cumulative, numbered


def valid(scores: DataFrame, column: str = "HGT_score") -> DataFrame:
    return scores.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).cast("double").alias("x"))


def cumulated(values: DataFrame) -> DataFrame:
    """(x, n, upto) of each distinct value, materialized: how many rows have it, and how many are up to it; values: (x).

    Rows are counted by value before they are shuffled, so a value of any number of rows is one row here.
    """
    return materialize(cumulative(values.groupBy("x").agg(F.count("*").alias("n")), "x"), "cumulated")


def at_ranks(counts: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at 1-based ranks; counts: of ``cumulated``. The ranks asked for go to the tasks, as many rows come back."""
    import numpy as np

    wanted = np.unique(np.array(ranks, np.int64))

    def run(batches):
        import pandas as pd

        for frame in batches:
            upto = frame["upto"].to_numpy(np.int64)
            low, high = np.searchsorted(wanted, upto - frame["n"].to_numpy(np.int64), side="right"), np.searchsorted(wanted, upto, side="right")
            many = high - low
            at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            yield pd.DataFrame({"rank": wanted[at], "x": np.repeat(frame["x"].to_numpy(), many)})

    return {r["rank"]: r["x"] for r in counts.mapInPandas(run, "rank bigint, x double").collect()}


def _between(n: int, q: float) -> tuple[int, int, float]:
    """The 1-based ranks that a quantile lies between, and how far it is on the way."""
    at = q * (n - 1)
    low = math.floor(at)
    return low + 1, min(low + 2, n), at - low


def quantiles(values: DataFrame, qs: tuple[float, ...]) -> tuple[int, dict[float, float]]:
    """(number of rows, exact quantiles, interpolated linearly), by rank: distinct values are sorted in ranges and only those asked for are looked up; values: (x)."""
    ranked = cumulated(values)
    n = ranked.agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    places = {q: _between(n, q) for q in qs} if n else {}
    at = at_ranks(ranked, [r for low, high, _ in places.values() for r in (low, high)]) if n else {}
    drop_scratch(ranked)
    return n, {q: at[low] + (at[high] - at[low]) * f for q, (low, high, f) in places.items()}


def describe(scores: DataFrame, column: str = "HGT_score") -> DataFrame:
    """One row. Quantiles interpolate linearly; deviation, skew and excess kurtosis are of the population; null for no rows."""
    d = valid(scores, column)
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    _, q = quantiles(d, tuple(names.values()))
    d = d.agg(F.count("*").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis"))
    d = d.select("*", *[F.lit(q.get(v)).cast("double").alias(k) for k, v in names.items()])
    return d.withColumn("iqr", F.col("q75") - F.col("q25"))


def empirical_cdf(scores: DataFrame, column: str = "HGT_score") -> DataFrame:
    """(x, cdf) by distinct value: counts are added up first, then ranges of values, then values in each range."""
    return _cdf(scores, column).select("x", "cdf")


def _cdf(scores: DataFrame, column: str) -> DataFrame:
    """(x, before, cdf): the share of rows below and up to each distinct value."""
    return _shares(cumulated(valid(scores, column)))


def _shares(counts: DataFrame) -> DataFrame:
    d = counts.crossJoin(counts.agg(F.max("upto").alias("all")))  # a single row
    return d.select("x", ((F.col("upto") - F.col("n")) / F.col("all")).alias("before"), (F.col("upto") / F.col("all")).alias("cdf"))


def histogram(scores: DataFrame, bins: int, low: float, high: float, column: str = "HGT_score") -> DataFrame:
    """(bin, n): equal bins 1..bins over [low, high]; the upper end belongs to the last."""
    b = F.least(F.floor((F.col("x") - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return valid(scores, column).where(F.col("x").between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def _gamma_p(a: float, x):
    """The regularised lower incomplete gamma function of an array: a series below a + 1, a continued fraction above."""
    import numpy as np

    x = np.asarray(x, float)
    out = np.zeros(len(x))
    with np.errstate(divide="ignore", over="ignore", under="ignore"):
        scale = np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - math.lgamma(a))
    low = (x > 0) & (x < a + 1)
    if low.any():
        v = x[low]
        term = np.full(len(v), 1 / a)
        total, k = term.copy(), a
        while (np.abs(term) > np.abs(total) * 1e-15).any():
            k += 1
            term = term * v / k
            total += term
        out[low] = np.minimum(1.0, total * scale[low])
    high = x >= a + 1
    if high.any():
        v, tiny = x[high], 1e-300
        b, c = v + 1 - a, np.full(high.sum(), 1 / tiny)
        d = 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(d == 0, tiny, d)
            c = b + an / c
            c = np.where(c == 0, tiny, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = 1 - scale[high] * h
    return out


def _normal_cdf(z):
    """By the incomplete gamma function of z * z / 2."""
    import numpy as np

    return 0.5 * (1 + np.sign(z) * _gamma_p(0.5, z * z / 2))


def distribution_cdf(name: str, p: tuple[float, ...], x):
    """The distribution function of an array of values."""
    import numpy as np

    x = np.asarray(x, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        if name == "normal":
            return _normal_cdf((x - p[0]) / p[1]) if p[1] > 0 else (x >= p[0]).astype(float)
        if name == "lognormal":
            if p[0] <= 0:
                return (x >= p[1]).astype(float)
            return np.where(x > 0, _normal_cdf(np.log(np.where(x > 0, x, 1.0) / p[1]) / p[0]), 0.0)
        if name == "exponential":
            return 1 - np.exp(-np.maximum(0.0, x - p[0]) / p[1]) if p[1] > 0 else (x >= p[0]).astype(float)
        return _gamma_p(p[0], (x - p[1]) / p[2])


def ks_p_value(d: float, n: int) -> float:
    """Two-sided, by the series with the small-sample correction of the argument."""
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def closed_form_fits(scores: DataFrame, column: str = "HGT_score") -> DataFrame:
    """One row: maximum-likelihood parameters; those for positive values are null if any value is not."""
    d = valid(scores, column)
    pos = F.min("x") > 0
    ln = F.log(F.when(F.col("x") > 0, F.col("x")))
    return d.agg(
        F.avg("x").alias("normal_loc"), F.stddev_pop("x").alias("normal_scale"), F.when(pos, F.stddev_pop(ln)).alias("lognormal_s"), F.when(pos, F.exp(F.avg(ln))).alias("lognormal_scale"),
        F.when(pos, F.min("x")).alias("exponential_loc"), F.when(pos, F.avg("x") - F.min("x")).alias("exponential_scale"), F.when(pos, F.log(F.avg("x")) - F.avg(ln)).alias("gamma_s"), F.count("*").alias("n"),
    )


def _gamma_shape(s: float) -> float:
    """Newton's method on log(k) - digamma(k) = s."""
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        h = 1e-5 * k
        f = math.log(k) - _digamma(k) - s
        step = f / ((math.log(k + h) - _digamma(k + h) - math.log(k - h) + _digamma(k - h)) / (2 * h))
        k = max(1e-8, k - step)
        if abs(step) < 1e-10 * k:
            break
    return k


#: Locations that one pass over the values tries, and passes that narrow them down.
LOCATIONS, NARROWED = 48, 8


def gamma_fit(counts: DataFrame) -> tuple[float, float, float] | None:
    """(shape, location, scale) of the greatest likelihood; counts: (x, n), positive values.

    For a location the best shape and scale follow from the means of the values above it and of their
    logarithms, so the likelihood is one of the location alone. A pass adds these means up for many
    locations below the least value; passes narrow them down around the greatest inner
    maximum. Where there is none, the likelihood grows towards the least value or
    without end, and the location is 0. None for equal values.
    """
    import numpy as np

    x, n = F.col("x"), F.col("n")
    r = counts.agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), (F.sum(x * n) / F.sum(n)).alias("mean"), (F.sum(F.log("x") * n) / F.sum(n)).alias("log")).first()
    if not r["n"] or r["high"] <= r["low"]:
        return None
    width = r["high"] - r["low"]

    def profile(gaps) -> list[tuple[float, float, float]]:
        """(log likelihood of a value, shape, scale) for the locations so far below the least value."""
        means = counts.agg(*[(F.sum(F.log(x - F.lit(float(r["low"] - g))) * n) / F.sum(n)).alias(f"g{k}") for k, g in enumerate(gaps)]).first()
        out = []
        for k, g in enumerate(gaps):
            mean = r["mean"] - r["low"] + g
            s = math.log(mean) - means[k]
            shape = _gamma_shape(s) if s > 1e-14 else 1e14
            out.append(((shape - 1) * means[k] - shape - shape * math.log(mean / shape) - math.lgamma(shape), shape, mean / shape))
        return out

    gaps, found = width * np.geomspace(1e-6, 1e3, LOCATIONS), None
    for _ in range(NARROWED):
        tried = profile(gaps.tolist())
        value = np.array([v for v, *_ in tried])
        inner = [k for k in range(1, len(gaps) - 1) if value[k] >= value[k - 1] and value[k] > value[k + 1] and tried[k][1] > 1]
        if not inner:
            break
        best = max(inner, key=lambda k: value[k])
        found = (tried[best][1], float(r["low"] - gaps[best]), tried[best][2])
        if gaps[best + 1] - gaps[best - 1] < 1e-7 * (gaps[best] + width):
            return found
        gaps = np.linspace(gaps[best - 1], gaps[best + 1], LOCATIONS)
    if found:
        return found
    s = math.log(r["mean"]) - r["log"]
    shape = _gamma_shape(s)
    return shape, 0.0, r["mean"] / shape


def fit_distributions(scores: DataFrame, column: str = "HGT_score") -> DataFrame:
    """(name, params, ks, p_value, quality), best first. Normal always; lognormal, gamma (of three parameters, ``gamma_fit``) and exponential if all values are positive."""
    spark, r = scores.sparkSession, closed_form_fits(scores, column).first()
    schema = "name string, params array<double>, ks double, p_value double"
    if not r["n"]:
        return spark.createDataFrame([], schema).withColumn("quality", fit_quality(F.col("ks")))
    fits = {"normal": (r["normal_loc"], r["normal_scale"])}
    if r["lognormal_s"] is not None:
        fits |= {"lognormal": (r["lognormal_s"], r["lognormal_scale"]), "exponential": (r["exponential_loc"], r["exponential_scale"])}
    counts = cumulated(valid(scores, column))
    if r["lognormal_s"] is not None and (gamma := gamma_fit(counts)):
        fits["gamma"] = gamma
    cdf = _shares(counts)

    def run(batches):
        import pandas as pd

        for frame in batches:
            for name, p in fits.items():
                f = distribution_cdf(name, p, frame["x"].to_numpy())
                worst = max((frame["cdf"] - f).abs().max(), (frame["before"] - f).abs().max()) if len(frame) else 0.0
                yield pd.DataFrame({"name": [name], "ks": [float(worst)]})

    worst = {x["name"]: x["ks"] for x in cdf.mapInPandas(run, "name string, ks double").groupBy("name").agg(F.max("ks").alias("ks")).collect()}
    rows = [(name, [float(v) for v in p], worst[name], ks_p_value(worst[name], r["n"])) for name, p in fits.items()]
    return spark.createDataFrame(rows, schema).withColumn("quality", fit_quality(F.col("ks"))).orderBy("ks")


def _drawn_ranks(n: int, q: float, replicates: int, seed) -> tuple:
    """For each resample of n of n values: the 1-based ranks that its quantile lies between.

    The k-th least of a resample with replacement has rank ceil(n U) with U the k-th
    least of n uniform numbers, Beta(k, n - k + 1); the next one is above it by the
    least of the n - k that are left. So a resample costs two draws, whatever n is.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    k, above, _ = _between(n, q)
    u = rng.beta(k, n - k + 1, replicates)
    v = u + (1 - u) * rng.beta(1, n - k, replicates) if above > k else u
    ranks = lambda x: np.clip(np.ceil(n * x), 1, n).astype(np.int64)
    return ranks(u), ranks(v)


def bootstrap_quantiles(spark: SparkSession, scores: DataFrame, quantiles: tuple[float, ...] = (0.95,), replicates: int = 10_000, confidence: float = 0.95, seed: int = 42, column: str = "HGT_score") -> DataFrame:
    """(quantile, point, lower, upper) of ``replicates`` seeded resamples.

    Ranks are drawn, not values: the driver holds two for each replicate and
    quantile, and as many values are looked up among the ranked scores.
    """
    import numpy as np

    schema = "quantile double, point double, lower double, upper double"
    ranked = cumulated(valid(scores, column))
    n = ranked.agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    if not n:
        return spark.createDataFrame([], schema)
    drawn = {q: _drawn_ranks(n, q, replicates, [seed, round(q * 10**6)]) for q in quantiles}
    places = {q: _between(n, q) for q in quantiles}
    at = at_ranks(ranked, [int(r) for q in quantiles for own in (*drawn[q], places[q][:2]) for r in np.unique(own)])
    drop_scratch(ranked)
    keys = np.array(sorted(at))
    values = np.array([at[k] for k in keys.tolist()])
    of = lambda ranks: values[np.searchsorted(keys, ranks)]
    tail, rows = 100 * (1 - confidence) / 2, []
    for q in quantiles:
        low, high, f = places[q]
        a, b = of(drawn[q][0]), of(drawn[q][1])
        got = a + (b - a) * f
        rows.append((q, float(of([low])[0] + (of([high])[0] - of([low])[0]) * f), float(np.percentile(got, tail)), float(np.percentile(got, 100 - tail))))
    return spark.createDataFrame(rows, schema)


def grouped_bootstrap(hits: DataFrame, group: str = "taxon_pair", value: str = "pident", quantile: float = 0.95, replicates: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(group, q95_lower_bound, q95_upper_bound): each group has a seed made of its name.

    Rows are numbered by group and value in ranges, so a large group is spread over
    them; of each group the ranks that its resamples draw are looked up, twice the
    replicates at most, and only those values meet in a task.
    """
    tail = 100 * (1 - confidence) / 2
    d = hits.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("x"))
    ranked = materialize(numbered(d.select(F.struct("g", "x").alias("s")), "s", "_n").select("s.g", "s.x", "_n"), "ranked")
    groups = materialize(ranked.groupBy("g").agg(F.count("*").alias("n"), (F.min("_n") - 1).alias("base")), "groups")

    def draw(name: str, n: int):
        import zlib

        return _drawn_ranks(n, quantile, replicates, [seed, zlib.crc32(name.encode())])

    def wanted(batches):
        import numpy as np
        import pandas as pd

        for frame in batches:
            for name, n, base in zip(frame["g"], frame["n"], frame["base"], strict=True):
                own = np.unique(np.concatenate(draw(name, int(n))))
                yield pd.DataFrame({"_n": own + base, "rank": own, "n": np.full(len(own), n)})

    ranks = groups.mapInPandas(wanted, "_n long, rank long, n long")

    def run(frame):
        import numpy as np
        import pandas as pd

        name, n = frame["g"].iloc[0], int(frame["n"].iloc[0])
        frame = frame.sort_values("rank")
        keys, values = frame["rank"].to_numpy(), frame["x"].to_numpy()
        a, b = (values[np.searchsorted(keys, r)] for r in draw(name, n))
        got = a + (b - a) * _between(n, quantile)[2]
        return pd.DataFrame({group: [name], "q95_lower_bound": [np.percentile(got, tail)], "q95_upper_bound": [np.percentile(got, 100 - tail)]})

    return ranked.join(ranks, "_n").select("g", "rank", "n", "x").groupBy("g").applyInPandas(run, f"{group} string, q95_lower_bound double, q95_upper_bound double")


def box_data(scores: DataFrame, column: str = "HGT_score") -> DataFrame:
    """One row for a box plot: quartiles, whiskers at the last values within 1.5 interquartile ranges, and how many values lie beyond."""
    d = valid(scores, column)
    _, q = quantiles(d, (0.25, 0.5, 0.75))
    if not q:
        return d.sparkSession.createDataFrame([], "q25 double, median double, q75 double, whisker_low double, whisker_high double, outliers bigint")
    low, high = q[0.25] - 1.5 * (q[0.75] - q[0.25]), q[0.75] + 1.5 * (q[0.75] - q[0.25])
    inside = F.when(F.col("x").between(low, high), F.col("x"))
    return d.agg(F.lit(q[0.25]).alias("q25"), F.lit(q[0.5]).alias("median"), F.lit(q[0.75]).alias("q75"), F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"), F.count_if(inside.isNull()).alias("outliers"))


def violin_data(scores: DataFrame, points: int = 100, column: str = "HGT_score") -> DataFrame:
    """(at, density): a Gaussian kernel density at even points, from counts of 20 bins a point; the width is by Scott's rule."""
    d = valid(scores, column)
    r = d.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.stddev_samp("x").alias("sd")).first()
    spark, schema = d.sparkSession, "at double, density double"
    if not r["n"] or not r["sd"]:
        return spark.createDataFrame([], schema)
    import numpy as np

    bins, width = 20 * points, r["sd"] * r["n"] ** -0.2
    counts = {x["bin"]: x["n"] for x in histogram(scores, bins, r["low"], r["high"], column).collect()}  # a row for each bin
    middle = r["low"] + (np.array(sorted(counts)) - 0.5) * (r["high"] - r["low"]) / bins
    weight = np.array([counts[k] for k in sorted(counts)], float)
    at = np.linspace(r["low"], r["high"], points)
    density = (np.exp(-0.5 * ((at[:, None] - middle) / width) ** 2) * weight).sum(axis=1) / (r["n"] * width * math.sqrt(2 * math.pi))
    return spark.createDataFrame(list(zip(at.tolist(), density.tolist(), strict=True)), schema)


def theoretical_curves(fits: DataFrame, low: float, high: float, points: int = 100) -> DataFrame:
    """(name, at, cdf) of each fitted distribution, for plots beside the empirical one; fits: a few rows."""
    import numpy as np

    at = np.linspace(low, high, points)
    rows = [(r["name"], float(x), float(c)) for r in fits.collect() for x, c in zip(at, distribution_cdf(r["name"], tuple(r["params"]), at), strict=True)]
    return fits.sparkSession.createDataFrame(rows, "name string, at double, cdf double")


def bootstrap_curve(spark: SparkSession, scores: DataFrame, column: str = "HGT_score") -> DataFrame:
    """Points and intervals of four high quantiles of 1,000 resamples, as a plot shows them."""
    return bootstrap_quantiles(spark, scores, (0.9, 0.95, 0.99, 0.995), 1000, column=column)


def high_confidence(scores: DataFrame, upper: float, column: str = "HGT_score") -> DataFrame:
    return scores.where(F.col(column) > upper)
