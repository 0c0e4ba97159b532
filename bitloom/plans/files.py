"""Queries that write text tables to the shared folder and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bitloom.functions import geometry
from bitloom.operators import graph, pose, retrieval
from bitloom.operators.lineage import shared_dir
from bitloom.plans.registry import query, table
from bitloom.plans.kernels import scene
from bitloom.plans.searches import _D, _WORDS, _centres, descriptors
from bitloom.sources import text


def _place(spark, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def _observations(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    zero = F.lit(0).cast("long")
    return d.select((F.floor(F.col("vec_id") / 4)).alias("point_id"), (F.col("vec_id") / 8).alias("x"), F.lit(-1.5).alias("y"), F.lit(2.0).alias("z"), F.col("label").alias("frame_nr"), F.col("label").cast("double").alias("u"), F.lit(0.25).alias("v"), "w0", "w1", *[zero.alias(f"w{k}") for k in range(2, 8)], "vec_id")


@query("S1 S2 S3 S6 S7 S8 S9 S22 S23 S25", f"WITH {_D} SELECT label AS frame_nr, vec_id / 8 AS x, w0, w1 FROM d WHERE label IN (SELECT r_regionkey FROM region)")
def observations_round_trip(spark, sf_dir):
    rows, place = _observations(spark, sf_dir), _place(spark, "observations")
    text.write_rows(rows, place, [c.split(" ")[0] for c in text.OBSERVATION])
    back = text.read_observations(spark, place)
    wanted = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("frame_nr"))
    return text.descriptors_of(back, wanted, "frame_nr").select("frame_nr", "x", "w0", "w1")


@query("S4 S5 S24", f"WITH {_D}, g AS (SELECT vec_id // 4 AS point_id, min(vec_id) AS a, max(vec_id) AS b, count(*) AS n FROM d GROUP BY ALL) SELECT point_id, a / 8 AS x, l.w0, l.w1 FROM g JOIN d l ON l.vec_id = b")
def history_round_trip(spark, sf_dir):
    rows, place = _observations(spark, sf_dir), _place(spark, "history")
    text.write_rows(rows.repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id"), place, [c.split(" ")[0] for c in text.HISTORY])
    return text.points_of(text.read_history(spark, place)).select("point_id", "x", "w0", "w1")


@query("S10 S11 S12 S29", f"WITH {_D} SELECT vec_id AS c_id, w0, w1, '8' AS k FROM d WHERE vec_id < 8")
def vocabulary_round_trip(spark, sf_dir):
    centres = descriptors(spark, sf_dir).where("vec_id < 8").select(F.col("vec_id").alias("c_id"), "w0", "w1")
    back, parameters = text.load_or_build(spark, _place(spark, "vocabulary"), lambda: (centres, 0.0, {"k": 8}))
    return back.withColumn("k", F.lit(parameters["k"]))


@query("S20 S21 S26 S27 S28", "SELECT s_suppkey AS seq, s_nationkey AS tag, s_suppkey * 1.0::DOUBLE AS p0, s_suppkey + 11.0::DOUBLE AS p11 FROM supplier")
def poses_round_trip(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    pose = F.array(*[(F.col("s_suppkey") + k).cast("double") for k in range(12)])
    rows = s.select(F.col("s_suppkey").alias("seq"), F.col("s_nationkey").alias("tag"), *text.pose_columns(pose))
    place = _place(spark, "poses")
    text.save_map(s.select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")), rows, place)
    back = text.read_rows(spark, f"{place}/poses", text.KEYFRAME_POSE).join(rows.select("seq", "tag"), "seq")
    text.collect_runs(back, f"{place}/runs", ["tag"])
    return spark.read.parquet(f"{place}/runs").select(F.col("seq").cast("long").alias("seq"), F.col("tag").cast("int").alias("tag"), "p0", "p11")


@query("S13", f"WITH {_WORDS} SELECT word, image_id, count(*) AS tf FROM vw GROUP BY ALL")
def inverted_file_round_trip(spark, sf_dir):
    """Built and saved, then found there and read."""
    df, place = descriptors(spark, sf_dir), _place(spark, "inverted")
    words = retrieval.visual_words(df, _centres(df)).join(df.select("vec_id", F.col("label").alias("image_id")), "vec_id")
    images = df.select("label").distinct().count()
    text.load_or_build_index(spark, place, lambda: retrieval.postings(words), images)
    return text.load_or_build_index(spark, place, lambda: None, images)


@query("S20 T11")
def recovery_records(spark, sf_dir):
    """Poses with stage timings and sizes, written as text beside their inliers' points, and read again."""
    place = _place(spark, "results")
    text.write_results(pose.recovered(scene(spark, sf_dir)), place)
    points = text.read_rows(spark, f"{place}/points3d", ["frame int", "x double", "y double", "z double"]).groupBy("frame").agg(F.count("*").alias("n_points"))
    return text.read_rows(spark, f"{place}/poses", text.RESULT).join(points, "frame")


@query("R14 W5", "SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN 1 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS turn FROM part")
def creation_order(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("level"), F.col("p_retailprice").alias("score"))
    return graph.creation_order(p).select("p_partkey", "turn")


@query("F26", "SELECT p_partkey, round(2 / 320.0::DOUBLE * p_size, 6) AS right_x, round(2 / 360.0::DOUBLE * p_size, 6) AS down_y FROM part")
def pixel_vectors(spark, sf_dir):
    camera = geometry.FieldOfViewCamera(w=0.0)
    p = table(spark, sf_dir, "part")
    right, down = geometry.pixel_vectors(camera, F.lit(300.0), F.lit(200.0), F.col("p_size").cast("double"), F.lit(2.0))
    return p.select("p_partkey", F.round(right[0], 6).alias("right_x"), F.round(down[1], 6).alias("down_y"))
