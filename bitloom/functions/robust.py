"""Robust weights and scales, as expressions on squared errors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors from the median absolute error to each estimator's scale.
TUKEY, CAUCHY, HUBER = 4.6851, 4.6851, 1.345
MAD_TO_SIGMA = 1.4826


def weight(name: str, error2: Column, sigma2: Column) -> Column:
    """The weight of an observation with this squared error."""
    if name == "tukey":
        return F.when(error2 > sigma2, 0.0).otherwise((1 - error2 / sigma2) * (1 - error2 / sigma2))
    if name == "cauchy":
        return 1 / (1 + error2 / sigma2)
    if name == "huber":
        return F.when(error2 < sigma2, 1.0).otherwise(F.sqrt(sigma2 / error2))
    if name == "least_squares":
        return F.lit(1.0)
    raise ValueError(f"no estimator is called {name}")


def sqrt_weight(name: str, error2: Column, sigma2: Column) -> Column:
    return F.sqrt(weight(name, error2, sigma2))


def objective(name: str, error2: Column, sigma2: Column) -> Column:
    """What an observation adds to the cost."""
    if name == "tukey":
        d = 1 - error2 / sigma2
        return F.when(error2 > sigma2, 1.0).otherwise(1 - d * d * d)
    if name == "cauchy":
        return F.log(1 + error2 / sigma2)
    if name == "huber":
        return F.when(error2 < sigma2, error2 / 2).otherwise(F.sqrt(sigma2) * (F.sqrt(error2) - F.sqrt(sigma2) / 2))
    if name == "least_squares":
        return error2
    raise ValueError(f"no estimator is called {name}")


def sigma_squared(name: str, sorted_errors2: Column, n: Column) -> Column:
    """The squared scale of ascending squared errors: from their upper median; null for fewer than four."""
    factor = {"tukey": TUKEY, "cauchy": CAUCHY, "huber": HUBER}[name]
    median = F.element_at(sorted_errors2, (F.floor(n / 2) + 1).cast("int"))
    sigma = F.lit(MAD_TO_SIGMA) * (1 + F.lit(5.0) / (n * 2 - 6)) * F.sqrt(median)
    return F.when(n >= 4, (F.lit(factor) * sigma) * (F.lit(factor) * sigma))


def ransac_rounds(p: float, outliers: float, sample: int, limit: int) -> int:
    """Samples needed to draw one free of outliers with probability p, at most limit."""
    clean = (1 - outliers) ** sample
    if clean <= 0:
        return limit
    if clean >= 1:
        return 1
    return min(limit, math.ceil(math.log(1 - p) / math.log(1 - clean)))
