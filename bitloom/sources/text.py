"""Headerless text tables: observations, histories, poses, logs. Schemas are given, never inferred."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of a 256-bit descriptor.
WORDS = 8
OBSERVATION = ["x double", "y double", "z double", "frame_nr int", "u double", "v double", *[f"w{k} long" for k in range(WORDS)]]
HISTORY = ["point_id long", *OBSERVATION]
FRAME_POSE = ["seq int", "t_ns long", *[f"p{k} double" for k in range(12)]]
KEYFRAME_POSE = ["seq int", *[f"p{k} double" for k in range(12)]]
RESULT = ["frame int", *[f"p{k} double" for k in range(12)], "t_reloc double", "t_prep double", "t_pair double", "query_size int", "map_size int", "inliers int"]


def read_rows(spark: SparkSession, path: str, columns: list[str], numbered: bool = False) -> DataFrame:
    """Rows of fields apart by white space; lines with fewer fields are left out, and a field that is no value of its type is null.

    numbered adds _line, by which rows order as in the files: (file, block, number within what a task read of it). Files
    order by their names.
    """
    lines = spark.read.text(path)
    if numbered:
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
        lines = lines.select("value", at.alias("_line"))
    parts = lines.withColumn("_f", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).where((F.length(F.trim("value")) > 0) & (F.size("_f") >= len(columns)))
    names = [c.split(" ") for c in columns]
    return parts.select(*(["_line"] if numbered else []), *[F.col("_f")[k].try_cast(kind).alias(name) for k, (name, kind) in enumerate(names)])


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return read_rows(spark, path, OBSERVATION)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Observations by point, oldest first, with run: a new one wherever the id changes from line to line, from 0."""
    rows = read_rows(spark, path, HISTORY, numbered=True).withColumn("_part", F.struct("_line.file", "_line.block"))
    w = W.partitionBy("_part").orderBy("_line")
    new = rows.withColumn("_new", (F.lag("point_id").over(w).isNull() | (F.lag("point_id").over(w) != F.col("point_id"))).cast("int"))
    ends = new.groupBy("_part").agg(F.max_by("point_id", "_line").alias("_last"), F.min_by("point_id", "_line").alias("_first"), F.sum("_new").alias("_n"))
    over = W.orderBy("_part")
    # one row per block of a file: a run may go on from the block before
    ends = ends.withColumn("_joined", F.coalesce((F.lag("_last").over(over) == F.col("_first")).cast("int"), F.lit(0)))
    ends = ends.withColumn("_before", F.sum(F.col("_n") - F.col("_joined")).over(over.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    return new.join(ends.select("_part", "_before"), "_part").withColumn("run", (F.sum("_new").over(w) - 1 + F.col("_before")).cast("long")).drop("_part", "_new", "_before")


def points_of(history: DataFrame) -> DataFrame:
    """One row a run: its id, the first position and the latest descriptor."""
    first = F.min_by(F.struct("x", "y", "z"), "_line").alias("f")
    last = F.max_by(F.struct(*[f"w{k}" for k in range(WORDS)]), "_line").alias("l")
    return history.groupBy("run").agg(F.first("point_id").alias("point_id"), first, last).select("run", "point_id", "f.*", "l.*")


def by_frame(observations: DataFrame) -> DataFrame:
    """Frames with all of their descriptors."""
    return observations.groupBy("frame_nr").agg(F.sort_array(F.collect_list(F.struct("u", "v", F.array(*[f"w{k}" for k in range(WORDS)]).alias("words")))).alias("observations"))


def read_frame_ids(spark: SparkSession, path: str) -> DataFrame:
    """Frame numbers, one a line; an empty list is an error."""
    ids = read_rows(spark, path, ["frame_nr int"])
    if ids.isEmpty():
        raise ValueError(f"{path} names no frame")
    return ids


def pose_columns(pose: Column) -> list[Column]:
    """An array of 12, rotation by columns and then translation, as columns p0 to p11."""
    return [pose[k].alias(f"p{k}") for k in range(12)]


def write_rows(df: DataFrame, path: str, columns: list[str] | None = None, separator: str = "\t") -> None:
    """Columns as text, apart by the separator and without a header; nulls are empty."""
    df.select(*(columns or df.columns)).write.option("sep", separator).option("header", "false").option("emptyValue", "").csv(path)


def write_values(df: DataFrame, path: str, value: Column) -> None:
    """One formatted value a line."""
    df.select(value.cast("string").alias("value")).write.text(path)


def write_results(results: DataFrame, path: str) -> None:
    """Localisation results as two tables: poses with timings and counts, and the inliers' points (frame, x, y, z)."""
    names = [c.split(" ")[0] for c in RESULT]
    write_rows(results, f"{path}/poses", names)
    points = results.select("frame", F.explode("points").alias("p")).select("frame", "p.x", "p.y", "p.z")
    write_rows(points, f"{path}/points3d")


#: What tells a vocabulary's folder from another, and the versions of it that are read; the last is written.
SIGNATURE, VERSIONS = "binary vocabulary", ("1",)


def save_vocabulary(centroids: DataFrame, cost: float, path: str, **parameters) -> None:
    """Centroids, and beside them rows with signature, version, cost and parameters."""
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    meta = [(k, str(v)) for k, v in {**parameters, "cost": cost, "signature": SIGNATURE, "version": VERSIONS[-1]}.items()]
    centroids.sparkSession.createDataFrame(meta, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(centroids, parameters); a folder of another kind or version is an error."""
    held = {r.name: r.value for r in spark.read.parquet(f"{path}/parameters").collect()}
    if held.pop("signature", None) != SIGNATURE:
        raise ValueError(f"{path} holds no vocabulary")
    if (version := held.pop("version", None)) not in VERSIONS:
        raise ValueError(f"{path} is of version {version}, which isn't read")
    return spark.read.parquet(f"{path}/centroids"), held


def load_or_build(spark: SparkSession, path: str, build) -> tuple[DataFrame, dict[str, str]]:
    """The vocabulary at path; where there is none, build() gives (centroids, cost, parameters), which is saved first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/parameters")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        centroids, cost, parameters = build()
        save_vocabulary(centroids, cost, path, **parameters)
    return load_vocabulary(spark, path)


def load_or_build_index(spark: SparkSession, path: str, build, images: int) -> DataFrame:
    """The inverted file (word, image_id, tf) at path; where there is none, what build() gives, which is saved first. One
    that is not of so many images is given with a warning."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(path)
    index = spark.read.parquet(path)
    held = index.select("image_id").distinct().count()
    if held != images:
        warnings.warn(f"{path} is of {held} images, not {images}", stacklevel=2)
    return index


def descriptors_of(images: DataFrame, wanted: DataFrame, image_col: str = "image_id") -> DataFrame:
    """Descriptors of the listed images."""
    return images.join(wanted.select(image_col), image_col, "left_semi")


def save_map(points: DataFrame, poses: DataFrame, path: str) -> None:
    """A map as two tables: points (x, y, z) and poses (seq and twelve numbers)."""
    write_rows(points, f"{path}/points", ["x", "y", "z"])
    write_rows(poses, f"{path}/poses", [c.split(" ")[0] for c in KEYFRAME_POSE])


def collect_runs(results: DataFrame, path: str, run_cols: list[str]) -> None:
    """Results of several runs under one folder, a subfolder for each run's settings."""
    results.write.mode("append").partitionBy(*run_cols).parquet(path)
