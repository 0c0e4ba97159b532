"""Binary means: majority votes, Lloyd rounds and their costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.functions import bits
from bitloom.operators import search
from bitloom.operators.sizing import small


def majority(df: DataFrame, by: str | None, words: list[str], width: int = 64) -> DataFrame:
    """One descriptor a group: a bit is set if over half of the rows (rounded down) have it. All bits in one aggregate."""
    out = []
    for k, w in enumerate(words):
        votes = [f"if(sum((`{w}` >> {j}) & 1) > floor(count(*) / 2), {1 << j}L, 0L)" for j in range(min(32, width - 32 * k))]
        out.append(F.expr(" | ".join(votes)).alias(w))
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(*out, F.count("*").alias("n"))


def assign(df: DataFrame, centroids: DataFrame, id_col: str = "vec_id", centroid_id: str = "c_id") -> DataFrame:
    """(id, c_id, d): each row's nearest centroid, ties to the smaller id. Centroids are few, or joined by their count."""
    words = search.words_of(df)
    c = centroids.select(F.col(centroid_id).alias("c_id"), *[F.col(w).alias(f"c_{w}") for w in words])
    d = bits.hamming([F.col(w) for w in words], [F.col(f"c_{w}") for w in words])
    met = df.join(small(c, 20_000))
    best = met.groupBy(id_col, *words).agg(F.min(F.struct(d.alias("d"), F.col("c_id").alias("c_id"))).alias("b"))
    return best.select(id_col, *words, F.col("b.c_id").alias("c_id"), F.col("b.d").alias("d"))


def seeds(df: DataFrame, k: int, seed: int, id_col: str = "vec_id") -> DataFrame:
    """k rows by seeded hash, numbered from 0: a draw without repetition that any engine's rerun repeats."""
    picked = df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(k)
    return picked.withColumn("c_id", (F.row_number().over(W.orderBy(F.xxhash64(F.lit(seed), id_col), id_col)) - 1).cast("long")).select("c_id", *search.words_of(df))


def update(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Majority centroids of the assignment; a centroid without rows becomes all zeros. Adds n, the rows of each."""
    words = search.words_of(assigned)
    voted = majority(assigned, "c_id", words, 32 * len(words))
    return centroids.select("c_id").join(voted, "c_id", "left").select("c_id", *[F.coalesce(w, F.lit(0)).alias(w) for w in words], F.coalesce("n", F.lit(0)).alias("n"))


def cost(assigned: DataFrame) -> DataFrame:
    """Mean distance over all rows; rows without a centroid count in the number but add nothing."""
    return assigned.agg((F.sum("d") / F.count("*")).alias("cost"), F.count("*").alias("n"), F.sum(F.col("d").isNull().cast("int")).alias("unmatched"))


def empty_clusters(centroids: DataFrame) -> DataFrame:
    """Centroids with fewer than two rows."""
    return centroids.where("n < 2").select("c_id", "n")


def refill(assigned: DataFrame, centroids: DataFrame, seed: int) -> DataFrame:
    """Centroids with the starved ones replaced by distinct rows of the largest clusters; one bounded pass.

    Clusters are taken from the largest down until twice as many rows as there are starved centroids are in hand.
    """
    words = search.words_of(assigned)
    starved = centroids.where("n < 2")
    need = starved.count()
    if not need:
        return centroids
    total = W.orderBy(F.desc("n"), "c_id").rowsBetween(W.unboundedPreceding, 0)
    rich = centroids.where("n >= 2").withColumn("upto", F.sum("n").over(total)).where(F.col("upto") - F.col("n") < 2 * need).select("c_id")
    order = W.orderBy("h", *words)
    drawn = assigned.join(small(rich), "c_id", "left_semi").select(*words).distinct().withColumn("h", F.xxhash64(F.lit(seed), *words)).orderBy("h", *words).limit(need).withColumn("r", F.row_number().over(order))
    slots = starved.select("c_id").withColumn("r", F.row_number().over(W.orderBy("c_id")))
    fresh = slots.join(drawn, "r").select("c_id", *words, F.lit(0).cast("long").alias("n"))
    return centroids.join(fresh.select("c_id"), "c_id", "left_anti").unionByName(fresh)


def binary_means(df: DataFrame, k: int, seed: int = 1, rounds: int = 31, tolerance: float = 1e-5, balance: bool = True, unchanged: bool = False, id_col: str = "vec_id") -> tuple[DataFrame, DataFrame, list[float]]:
    """(centroids, assignment, costs): Lloyd rounds until the cost falls by less than tolerance, or none changes.

    A cost that rises doesn't end it. Each round is written to the shared folder and the one before it deleted; only the
    cost comes to the driver.
    """
    from bitloom.operators.lineage import cut, drop

    words = search.words_of(df)
    centroids = cut(seeds(df, k, seed, id_col))
    assigned = cut(assign(df.select(id_col, *words), centroids, id_col))
    costs = [cost(assigned).first().cost]
    for r in range(rounds):
        old = [centroids, assigned]
        new = cut(update(assigned, centroids))
        if balance:
            old.append(new)
            new = cut(refill(assigned, new, seed + r + 1))
        same = unchanged and new.select("c_id", *words).exceptAll(centroids.select("c_id", *words)).isEmpty()
        centroids = new
        assigned = cut(assign(df.select(id_col, *words), centroids, id_col))
        costs.append(cost(assigned).first().cost)
        drop(*old)
        if same or not unchanged and costs[-1] is not None and 0 <= costs[-2] - costs[-1] < tolerance:
            break
    return centroids, assigned, costs


def medoid_swap(df: DataFrame, medoids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The best medoid of every cluster: the row with the least summed distance to its cluster, ties to the smaller id.

    A sum of Hamming distances is a sum over bits: a bit that is set differs from the cluster's rows without it, one that
    isn't from those with it. So a cluster is its rows' number and its bits' counts, and no pairs are made.
    """
    words = search.words_of(df)
    assigned = assign(df.select(id_col, *words), medoids, id_col)
    columns, width = [F.col(w) for w in words], 32 * len(words)
    counts = assigned.groupBy("c_id").agg(F.count("*").alias("n"), F.array(*[F.sum(bits.bit(columns, k)) for k in range(width)]).alias("ones"))
    apart = [F.when(bits.bit(columns, k) == 1, F.col("n") - F.col("ones")[k]).otherwise(F.col("ones")[k]) for k in range(width)]
    # one row a cluster
    total = assigned.join(small(counts), "c_id").select("c_id", F.col(id_col).alias("id"), *words, reduce(Column.__add__, apart).alias("cost"))
    best = total.groupBy("c_id").agg(F.min(F.struct("cost", "id", *words)).alias("b"))
    return best.select("c_id", F.col("b.id").alias("medoid"), F.col("b.cost").alias("cost"), *[F.col(f"b.{w}").alias(w) for w in words])


def nearest_centroids(queries: DataFrame, centroids: DataFrame, probes: int, id_col: str = "vec_id") -> DataFrame:
    """(q_id, c_id) of each query's `probes` nearest centroids, ties to the smaller id."""
    words = search.words_of(queries)
    c = centroids.select("c_id", *[F.col(w).alias(f"c_{w}") for w in words])
    d = bits.hamming([F.col(w) for w in words], [F.col(f"c_{w}") for w in words])
    met = queries.select(F.col(id_col).alias("q_id"), *words).join(small(c, 20_000)).select("q_id", "c_id", d.alias("d"))
    return met.withColumn("r", F.row_number().over(W.partitionBy("q_id").orderBy("d", "c_id"))).where(F.col("r") <= probes).select("q_id", "c_id")


def hashed_centroids(queries: DataFrame, centroids: DataFrame, params: search.LshParams, probes: int, id_col: str = "vec_id") -> DataFrame:
    """(q_id, c_id) of each query's nearest centroids among those that share a bucket with it; a query that meets none looks
    at all of them."""
    words = search.words_of(queries)
    both = lambda df, i: df.select(F.col(i).cast("long").alias("vec_id"), *words)
    met = search.collisions(both(queries, id_col), both(centroids, "c_id"), params, exclude_self=False).select("q_id", F.col("m_id").alias("c_id"), "d").distinct()
    found = met.withColumn("r", F.row_number().over(W.partitionBy("q_id").orderBy("d", "c_id"))).where(F.col("r") <= probes).select("q_id", "c_id")
    alone = queries.join(small(found.select(F.col("q_id").alias(id_col)).distinct()), id_col, "left_anti")
    return found.unionByName(nearest_centroids(alone, centroids, probes, id_col))


def pruned_nearest(queries: DataFrame, df: DataFrame, centroids: DataFrame, id_col: str = "vec_id", probes: int = 1, chosen: DataFrame | None = None) -> DataFrame:
    """Nearest rows, with ties, within the clusters of each query's `probes` nearest centroids, or of those chosen for it."""
    words = search.words_of(df)
    if chosen is None:
        chosen = nearest_centroids(queries, centroids, probes, id_col)
    q = queries.select(F.col(id_col).alias("q_id"), *[F.col(w).alias(f"q_{w}") for w in words]).join(chosen, "q_id")
    m = assign(df.select(id_col, *words), centroids, id_col).select(F.col(id_col).alias("m_id"), "c_id", *[F.col(w).alias(f"m_{w}") for w in words])
    # the queries are a stated set; where it is small no cluster's rows are gathered in one task
    met = m.join(small(q), "c_id").where("q_id != m_id").select("q_id", "m_id", search._distance(words).alias("d"))
    return search.nearest_with_ties(met)
