"""Visual words and image retrieval over them. The score is TF-IDF dot product over image norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.functions import geometry
from bitloom.operators import cluster
from bitloom.operators.sizing import small


def visual_words(df: DataFrame, centroids: DataFrame, id_col: str = "vec_id", all_ties: bool = False) -> DataFrame:
    """(id, word, d): the nearest centroid's id, or with all_ties every one at the least distance."""
    if not all_ties:
        return cluster.assign(df, centroids, id_col).select(id_col, F.col("c_id").alias("word"), "d")
    from bitloom.functions import bits
    from bitloom.operators.search import words_of

    words = words_of(df)
    c = centroids.select(F.col("c_id").alias("word"), *[F.col(w).alias(f"c_{w}") for w in words])
    met = df.select(id_col, *words).join(small(c, 20_000)).select(id_col, "word", bits.hamming([F.col(w) for w in words], [F.col(f"c_{w}") for w in words]).alias("d"))
    return met.withColumn("r", F.rank().over(W.partitionBy(id_col).orderBy("d"))).where("r = 1").drop("r")


def postings(words: DataFrame, image_col: str = "image_id") -> DataFrame:
    """The inverted file: (word, image, tf)."""
    return words.groupBy("word", F.col(image_col).alias("image_id")).agg(F.count("*").alias("tf"))


def scores(query_words: DataFrame, index: DataFrame) -> DataFrame:
    """(image_id, score) of all images that share a word with the query; query_words: word and tf."""
    images = index.agg(F.countDistinct("image_id").alias("n"))
    idf = index.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(images)).select("word", F.log(F.col("n") / F.col("df") + 1).alias("idf"))
    weighted = index.join(idf, "word").select("word", "image_id", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("image_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = query_words.groupBy("word").agg(F.sum("tf").alias("qtf")).join(idf, "word").select("word", (F.col("qtf") * F.col("idf")).alias("qw"))
    dots = weighted.join(asked, "word").groupBy("image_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dots.join(norms, "image_id").select("image_id", (F.col("dot") / F.col("norm")).alias("score"))


def best_images(scored: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The k best, ties to the smaller id; allowed keeps the images of an area. Fewer rows are not filled up."""
    if allowed is not None:
        scored = scored.join(allowed.select("image_id"), "image_id", "left_semi")
    return scored.orderBy(F.desc("score"), "image_id").limit(k)


def in_area(features: DataFrame, image_col: str, x: str, y: str, centre: tuple[float, float], radius: float) -> DataFrame:
    """Every image's mean feature position, and whether it is within the radius; images outside stay, as false."""
    mean = features.groupBy(image_col).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    d = geometry.distance([F.col("mx"), F.col("my")], [F.lit(centre[0]), F.lit(centre[1])])
    return mean.withColumn("d", d).withColumn("inside", d <= radius)


def surrounding(views: DataFrame, of: DataFrame, radius: float, degrees: float, id_col: str) -> DataFrame:
    """(id, near_id): views within the radius of each of `of` and turned by at most so many degrees, themselves included."""
    from bitloom.operators.spatial import within

    met = within(of, views, radius, id_col, id_col)
    return met.where(geometry.angle_apart(F.col("l_angle"), F.col("r_angle")) <= degrees)
