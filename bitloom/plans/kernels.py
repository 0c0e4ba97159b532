"""Queries on dense kernels. Their scenes are made from the driver tables, so that the truth is known."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators import pose
from bitloom.plans.registry import query, table


def scene(spark, sf_dir) -> DataFrame:
    """(frame, x, y, z, u, v, d): points made from parts, 200 a frame; frames turn, and a fifth of the pixels are wrong."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.floor(k / 200).alias("frame"),
        ((k * 37 % 101) / 50.0 - 1).alias("x"),
        ((k * 53 % 103) / 51.0 - 1).alias("y"),
        (F.col("p_size") % 17 / 8.0 + 3).alias("z"),
        (k % 5 == 0).alias("wrong"),
    )
    angle = F.col("frame") % 50 * 0.02 + 0.3
    cx = F.cos(angle) * F.col("x") - F.sin(angle) * F.col("y") + 0.1
    cy = F.sin(angle) * F.col("x") + F.cos(angle) * F.col("y") - 0.2
    cz = F.col("z") + 1
    off = F.when(F.col("wrong"), 60.0).otherwise(0.0)
    return rows.select("frame", "x", "y", "z", (cx / cz * 300 + 320 + off).alias("u"), (cy / cz * 300 + 240 - off).alias("v"), F.when(F.col("wrong"), 100).otherwise((F.col("x") * 1000).cast("int") % 50).cast("int").alias("d"))


@query("R1 R2 R3 R4 R5 P10 F18 F19 F21 F27 W7")
def pose_prosac(spark, sf_dir):
    return pose.relocalise(scene(spark, sf_dir))


@query("R2 R4")
def pose_ransac(spark, sf_dir):
    return pose.relocalise(scene(spark, sf_dir), pose.PoseParams(rounds=100), progressive=False)


@query("R6 A15 A16")
def pose_refined_only(spark, sf_dir):
    return pose.relocalise(scene(spark, sf_dir), sampled=False)


@query("R12 A17")
def dominant_plane(spark, sf_dir):
    """Planes of points whose height follows their place, but for every tenth; one per 200 parts."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 200).alias("plane"), (F.col("p_partkey") % 97 / 10.0).alias("x"), (F.col("p_partkey") % 89 / 10.0).alias("y"), F.col("p_partkey"))
    p = p.select("plane", "x", "y", F.when(F.col("p_partkey") % 10 == 0, 50.0).otherwise(F.col("x") * 0.2 - F.col("y") * 0.1 + 3).alias("z"))

    def fit(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values(["x", "y", "z"])
        if len(pdf) < 3:
            return {"nx": None, "ny": None, "nz": None, "inliers": 0}
        n, _, inliers = pose.dominant_plane(pdf[["x", "y", "z"]].to_numpy())
        n = n * np.sign(n[2])
        return {"nx": round(float(n[0]), 6), "ny": round(float(n[1]), 6), "nz": round(float(n[2]), 6), "inliers": int(inliers.sum())}

    return pose.per_group(p, "plane", fit, "plane long, nx double, ny double, nz double, inliers long")


def two_view(pdf: pd.DataFrame) -> dict:
    """Of one frame's points, seen as a plane in two views: the errors of the motion and, at most, of the points triangulated."""
    pdf = pdf.sort_values(["x", "y"])
    if len(pdf) < 8:
        return {"rotation_error": None, "point_error": None}
    r, t = pose.se3_exp(np.array([0.2, -0.1, 0.3, 0.02, 0.05, 0.1 + 0.01 * float(pdf["frame"].iloc[0] % 30)]))
    plane = np.column_stack([pdf["x"], pdf["y"], 4 + 0.1 * pdf["x"]])
    a, moved = plane[:, :2] / plane[:, 2:], plane @ r.T + t
    b = moved[:, :2] / moved[:, 2:]
    h = pose.robust_homography(a, b)
    got = min(pose.plausible_motions(pose.decompose(h), a, b), key=lambda m: np.linalg.norm(m[0] - r))
    scale = np.linalg.norm(t) / max(np.linalg.norm(got[1]), 1e-12)
    back = np.array([pose.triangulate(got[0], got[1] * scale, y, x) for x, y in zip(a, b)])
    return {"rotation_error": round(float(np.linalg.norm(got[0] - r)), 4), "point_error": round(float(np.abs(back - plane).max()), 3)}


@query("R9 R13 F25")
def two_view_motion(spark, sf_dir):
    """Homography of a plane in two views, its motion, and all points triangulated again; one row per frame."""
    s = scene(spark, sf_dir).select("frame", "x", "y")
    return pose.per_group(s, "frame", two_view, "frame long, rotation_error double, point_error double")


@query("R10 R11 R22 A18")
def bundle_adjustment(spark, sf_dir):
    """Cameras and points set off their places and brought back, 40 parts a bundle; the pixels that are wrong are told apart."""
    parts = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 40).alias("bundle"), "p_partkey", "p_size")

    def fit(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values("p_partkey")
        rng = np.random.default_rng(3)
        points = np.column_stack([pdf["p_partkey"] * 37 % 41 / 20 - 1, pdf["p_partkey"] * 17 % 43 / 21 - 1, pdf["p_size"] % 17 / 8 + 3])
        cameras = [(*pose.se3_exp(np.array([0.3 * k, 0.1 * k, 0, 0, 0.05 * k, 0])), k < 2) for k in range(5)]
        rows = []
        for c, (r, t, _) in enumerate(cameras):
            moved = points @ r.T + t
            rows += [(c, k, *(moved[k, :2] / moved[k, 2])) for k in range(len(points))]
        measured = np.array(rows)
        measured[::23, 2] += 0.3
        off = [(r, t, f) if f else (pose.se3_exp(rng.normal(0, 0.01, 6))[0] @ r, t + rng.normal(0, 0.01, 3), f) for r, t, f in cameras]
        b = pose.Bundle(off, points + rng.normal(0, 0.02, points.shape), measured)
        steps, _ = b.solve()
        return {"steps": steps, "point_error": round(float(np.median(np.abs(b.points - points))), 5), "outliers": int(b.outliers(floor=1e-6).sum()), "wrong": len(measured[::23])}

    return pose.per_group(parts, "bundle", fit, "bundle long, steps int, point_error double, outliers long, wrong long")
