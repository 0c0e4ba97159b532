"""Aggregates over groups: robust scales and locations, depths, tracking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import robust
from bitloom.operators.sizing import small


def at_ranks(df: DataFrame, by: list[str], value: str, **ranks) -> DataFrame:
    """Per group n, its number of values, and under each given name the element at that place, from 0, of its ascending
    values; a place is an expression over n. Null values don't count; a place beyond the values gives null.

    Exact for groups of any size: equal values meet in one row with their count, runs of the order (group, value) are dealt
    to tasks, and a value's place is what its group has in earlier runs plus the running count in its own.
    """
    from pyspark.sql import Window as W

    from bitloom.operators.lineage import cut

    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).count()
    # where runs are cut depends on a sample, so they are written before they are told by number
    counted = cut(counted.repartitionByRange(*by, value).select(*by, F.col(value).alias("_v"), F.col("count").alias("_c"), F.spark_partition_id().alias("_p")))
    runs = counted.groupBy(*by, "_p").agg(F.sum("_c").alias("_s"))
    # as many rows as groups and runs together
    sizes = runs.select(*by, "_p", F.sum("_s").over(W.partitionBy(*by)).alias("n"), (F.sum("_s").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")).alias("_b"))
    upto = F.sum("_c").over(W.partitionBy(*by, "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    placed = counted.withColumn("_u", upto).join(small(sizes), [*by, "_p"])
    end = F.col("_b") + F.col("_u")
    holds = lambda rank: (rank < end) & (rank >= end - F.col("_c"))
    return placed.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(holds(rank), F.col("_v"))).alias(name) for name, rank in ranks.items()])


def upper_medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group n and the element at n div 2 of its ascending values."""
    return at_ranks(df, by, value, median=F.floor(F.col("n") / 2))


def robust_sigma(df: DataFrame, by: list[str], error2: str) -> DataFrame:
    """Squared scales of each estimator from the upper median of squared errors; null for groups under four."""
    m = upper_medians(df, by, error2)
    s = lambda name: robust.sigma_squared(name, F.array("median"), F.col("n"))
    base = 1.4826 * (1 + F.lit(5.0) / (F.col("n") * 2 - 6)) * F.sqrt("median")
    scaled = lambda f: F.when(F.col("n") >= 4, (f * base) * (f * base))
    return m.select(*by, "n", scaled(robust.TUKEY).alias("tukey"), scaled(robust.CAUCHY).alias("cauchy"), scaled(robust.HUBER).alias("huber"))


def robust_location(df: DataFrame, by: list[str], value: str, estimator: str = "tukey", prior: float = 0.0) -> DataFrame:
    """One reweighted step from each group's mean: the weighted mean of its values, and the weights' sum.

    prior adds so much weight at the mean, which keeps a step small where little speaks for it.
    """
    mean = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    rows = df.join(mean, by).withColumn("_e2", (F.col(value) - F.col("_mean")) * (F.col(value) - F.col("_mean")))
    sigma = robust_sigma(rows, by, "_e2").select(*by, F.col(estimator).alias("_s2"))
    weighted = rows.join(sigma, by).withColumn("_w", robust.weight(estimator, F.col("_e2"), F.col("_s2")))
    total = F.sum("_w") + prior
    return weighted.groupBy(*by).agg(((F.sum(F.col("_w") * F.col(value)) + prior * F.first("_mean")) / total).alias("location"), F.sum("_w").alias("weight"))


def depth_stats(df: DataFrame, by: list[str], depth: str, least: int = 0) -> DataFrame:
    """Mean and population deviation of depths; null for groups of `least` rows or fewer."""
    n, z = F.count(depth), F.col(depth)
    mean = F.avg(z)
    sigma = F.sqrt(F.greatest(F.avg(z * z) - mean * mean, F.lit(0.0)))
    return df.groupBy(*by).agg(n.alias("n"), F.when(n > least, mean).alias("depth_mean"), F.when(n > least, sigma).alias("depth_sigma"))


def search_counters(df: DataFrame, by: list[str], level: str, found: str) -> DataFrame:
    """Attempts and finds per group and level."""
    return df.groupBy(*by, level).agg(F.count("*").alias("attempted"), F.sum(F.col(found).cast("int")).alias("found"))


def tracking_quality(df: DataFrame, by: list[str], level: str, found: str, distance_excess: str | None = None) -> DataFrame:
    """GOOD, DODGY or BAD per group: by the share found, and on coarse levels (2 and up) among ten attempts or more.

    Over 0.3 found in all is GOOD. Coarse finds under 0.13 are BAD. A group whose distance is excessive is BAD where it
    would be DODGY.
    """
    f = F.col(found).cast("int")
    coarse = F.col(level) >= 2
    a = df.groupBy(*by).agg(
        F.count("*").alias("attempted"),
        F.sum(f).alias("found"),
        F.sum(coarse.cast("int")).alias("coarse_attempted"),
        F.sum(F.when(coarse, f).otherwise(0)).alias("coarse_found"),
        (F.max(F.col(distance_excess).cast("int")) if distance_excess else F.lit(0)).alias("excess"),
    )
    total = F.col("found") / F.col("attempted")
    large = F.when(F.col("coarse_attempted") > 10, F.col("coarse_found") / F.col("coarse_attempted")).otherwise(total)
    quality = F.when(total > 0.3, "GOOD").when(large < 0.13, "BAD").when(F.col("excess") == 1, "BAD").otherwise("DODGY")
    return a.select(*by, "attempted", "found", quality.alias("quality"))


def plane_sums(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group the mean of x, y, z and the six entries of their scatter matrix."""
    x = {c: F.col(c) for c in "xyz"}
    n = F.count("*")
    out = [F.avg(c).alias(f"m{c}") for c in "xyz"]
    for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"):
        out.append((F.sum(x[a] * x[b]) - F.sum(x[a]) * F.sum(x[b]) / n).alias(f"s{a}{b}"))
    return df.groupBy(*by).agg(n.alias("n"), *out)


def block_sums(df: DataFrame, by: list[str], left: list[list], right: list[list], weight) -> DataFrame:
    """Per group the weighted sums that normal equations are made of: s_i_j, the sum over rows and residuals of
    weight * left[r][i] * right[r][j]. left and right: for every residual the expressions of its derivatives (or of itself).

    By camera, by point or by both these are the blocks of a bundle; sums are taken before the shuffle.
    """
    out = []
    for i in range(len(left[0])):
        for j in range(len(right[0])):
            total = sum((a[i] * b[j] for a, b in zip(left[1:], right[1:])), left[0][i] * right[0][j])
            out.append(F.sum(weight * total).alias(f"s_{i}_{j}"))
    return df.groupBy(*by).agg(*out)
