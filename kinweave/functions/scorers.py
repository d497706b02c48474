"""The seven scoring methods as Column expressions over a scored hit.

Columns they read: n_int, similarity, and what their method needs of n_int_mean,
s_mean, mu, sigma (of the hit's distance), tax_mu_a, tax_sd_a, tax_mu_b, tax_sd_b,
cdf, n_int_max, rank.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class ScoringMethod(str, Enum):
    CLASSIC = "classic"
    ZSCORE = "zscore"
    MODIFIED = "modified"
    COMBINED = "combined"
    EXPONENTIAL = "exponential"
    RANKING = "ranking"
    RANKING_TH = "ranking_th"

    @property
    def ranks(self) -> bool:
        return self in (ScoringMethod.RANKING, ScoringMethod.RANKING_TH)




def classic() -> Column:
    scale = F.col("n_int_mean") * F.col("s_mean")
    return F.when((F.col("n_int_mean") > 0) & (F.col("s_mean") > 0), F.col("n_int") * F.col("similarity") / scale).otherwise(0.0)


def zscore() -> Column:
    return F.when(F.col("sigma") > 0, (F.col("similarity") - F.col("mu")) / F.col("sigma")).otherwise(0.0)


def modified() -> Column:
    return F.when(F.col("mu") > 0, F.col("similarity") / F.col("mu") * F.log(F.col("n_int") + 1.0)).otherwise(0.0)


def combined() -> Column:
    weight = 1 + F.log(F.col("n_int").cast("double")) / F.log(F.col("n_int_max").cast("double"))
    return F.when((F.col("n_int") <= 0) | (F.col("n_int_max") <= 1), zscore()).otherwise(zscore() * weight)


def exponential(exponent: float = 1.0) -> Column:
    local = (F.col("similarity") - (F.col("tax_mu_a") + F.col("tax_mu_b")) / 2) / F.greatest("tax_sd_a", "tax_sd_b", F.lit(5.0))
    z = F.when(F.col("tax_mu_a").isNotNull() & F.col("tax_mu_b").isNotNull(), local).otherwise(zscore())
    return F.when(z < 0, 0.0).otherwise(z * F.pow(1 + F.coalesce(F.col("cdf"), F.lit(0.0)), F.lit(exponent)))


def ranking() -> Column:
    n = F.col("n_int").cast("double")
    return F.when(F.col("rank") > 0, n * n * F.col("similarity") / F.sqrt(F.col("rank").cast("double"))).otherwise(0.0)


def ranking_th() -> Column:
    return F.when((F.col("rank") > 0) & (F.col("n_int") > 1), (F.col("n_int") + 1) * F.col("similarity") / F.col("rank")).otherwise(0.0)


SCORERS: dict[ScoringMethod, Callable[[], Column]] = {m: globals()[m.value] for m in ScoringMethod}


def scorer(method: ScoringMethod | str) -> Callable[[], Column]:
    """Raises ValueError for an unknown method."""
    return SCORERS[ScoringMethod(method)]
