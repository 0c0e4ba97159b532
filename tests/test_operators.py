"""Properties of the operators that the queries' SQL doesn't reach."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import bits, geometry, robust
from bitloom.operators import cluster, graph, pose, search, spatial, stats
from bitloom.operators.sizing import small


def words(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, w0 long, w1 long")


def test_distances_grow_with_set_bits_and_agree(spark):
    rows = [(0, 0, 0), (1, 1, 0), (2, 1 | 1 << 8, 0), (3, 1 | 1 << 8, 1 << 8), (4, 0xFFFFFFFF, 0xFFFFFFFF)]
    df = words(spark, rows)
    d = {(r.q_id, r.m_id): r.d for r in search.pairs(df, df).collect()}
    assert [d[0, k] for k in (1, 2, 3, 4)] == [1, 2, 3, 64] and all(d[a, b] == d[b, a] for a, b in d)
    arrays = df.select("vec_id", F.array("w0", "w1").alias("a"))
    zero = arrays.where("vec_id = 0").select(F.col("a").alias("z"))
    assert sorted(r.d for r in arrays.join(F.broadcast(zero)).select(bits.hamming_arrays(F.col("a"), F.col("z")).alias("d")).collect()) == [0, 1, 2, 3, 64]


def test_one_zero_among_ones(spark):
    full = (1 << 32) - 1
    rows = [(k, full ^ (1 << k if k < 32 else 0), full ^ (1 << k - 32 if k >= 32 else 0)) for k in range(64)]
    assert {r.n for r in words(spark, rows).select(bits.popcount([F.col("w0"), F.col("w1")]).alias("n")).collect()} == {63}


def test_bytes_and_words_are_one_order(spark):
    row = spark.range(1).select(bits.pack_bytes([F.lit(b) for b in (0x12, 0x34, 0x56, 0xF8)]).alias("w")).select("w", *[b.alias(f"b{k}") for k, b in enumerate(bits.unpack_bytes(F.col("w")))]).first()
    assert tuple(row) == (0x123456F8, 0x12, 0x34, 0x56, 0xF8)
    for byte in range(8):
        for b in range(8):
            word, shift = bits.byte_order_position(byte, b)
            assert word == byte // 4 and shift == (3 - byte % 4) * 8 + b


def test_majority_is_strict(spark):
    df = words(spark, [(k, 3 if k < 10 else 0, 7 if k < 75 else 0) for k in range(100)])
    assert tuple(cluster.majority(df, None, ["w0", "w1"]).select("w0", "w1").first()) == (0, 7)
    assert cluster.majority(df.where("vec_id in (9, 10)"), None, ["w0", "w1"]).first().w0 == 0


def test_one_bucket_means_full_recall(spark):
    rng = random.Random(0)
    df = words(spark, [(k, rng.getrandbits(32) & ~1, rng.getrandbits(32)) for k in range(80)])
    exact = search.nearest_with_ties(search.pairs(df, df))

    class Same(search.LshParams):
        def functions(self):
            return [[0]]

    assert search.recall(exact, search.nearest_with_ties(search.lsh_candidates(df, df, Same()))).first().recall == 1
    r = search.recall(exact, search.nearest_with_ties(search.lsh_candidates(df, df, search.LshParams(2, 12)))).first().recall
    assert 0 <= r <= 1


def test_hash_draws():
    rng = random.Random(1)
    assert all(set(search.weighted_function(rng, [0.0] * 10 + [1.0] * 54, 5)) <= set(range(10)) for _ in range(50))
    with pytest.raises(ValueError):
        search.weighted_function(rng, [1.0] * 64, 1)
    with pytest.raises(ValueError):
        search.LshParams(bits=33)
    c = np.eye(6)
    c[0, 1] = c[1, 0] = 0.9
    assert search.correlated_function(rng, c, 2, 0, most=True, soft=False) == [0, 1]
    assert 1 not in search.correlated_function(rng, c, 5, 0, soft=False)[:5]
    assert bits.support([[0, 33], [0, 5]], 2) == [33, 2]


def test_every_query_is_answered(spark):
    rng = random.Random(2)
    df = words(spark, [(k, rng.getrandbits(32), rng.getrandbits(32)) for k in range(120)])
    got = search.multi_probe(df.where("vec_id < 30"), df, search.LshParams(1, 14)).select("q_id").distinct().count()
    assert got == 30
    one = search.one_per_query(df, search.lsh_candidates(df.where("vec_id < 0"), df, search.LshParams()))
    assert one.count() == 120 and one.where("m_id is null and d is null").count() == 120


def test_binary_means_find_planted_clusters(spark):
    rng = random.Random(3)
    centres = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(4)]
    flip = lambda w: w ^ (1 << rng.randrange(32))
    df = words(spark, [(k, flip(centres[k % 4][0]), flip(centres[k % 4][1])) for k in range(120)])
    centroids, assigned, costs = cluster.binary_means(df, 4, seed=3, rounds=8)
    assert assigned.count() == 120 and centroids.count() == 4 and min(costs) >= 0
    assert centroids.agg(F.sum("n")).first()[0] in (120, 120 - centroids.where("n = 0").count())
    best = cluster.binary_means(df, 4, seed=3, rounds=8, unchanged=True)[2][-1]
    assert best <= costs[0]


def test_starved_clusters_are_refilled(spark):
    df = words(spark, [(k, k, 0) for k in range(20)])
    centroids = spark.createDataFrame([(0, 0, 0), (1, 0xFFFFFFFF, 0xFFFFFFFF)], "c_id long, w0 long, w1 long")
    assigned = cluster.assign(df, centroids)
    new = cluster.update(assigned, centroids)
    assert {r.c_id: (r.w0, r.n) for r in new.collect()}[1] == (0, 0) and cluster.empty_clusters(new).count() == 1
    filled = cluster.refill(assigned, new, 1)
    assert filled.count() == 2 and filled.where("c_id = 1").first().w0 in range(20)


def test_upper_medians_and_scales(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (3, 0, 2, 1)] + [("b", float(x)) for x in (5, 1, 9)], "g string, v double")
    assert {r.g: (r.n, r["median"]) for r in stats.upper_medians(df, ["g"], "v").collect()} == {"a": (4, 2.0), "b": (3, 5.0)}
    sigma = {r.g: r.tukey for r in stats.robust_sigma(df, ["g"], "v").collect()}
    assert sigma["b"] is None and sigma["a"] == pytest.approx((4.6851 * 1.4826 * (1 + 5 / 2) * math.sqrt(2)) ** 2)


def test_estimators(spark):
    row = spark.range(1).select(*[f(n, F.lit(4.0), F.lit(s)).alias(f"{f.__name__}_{n}_{k}") for f in (robust.weight, robust.sqrt_weight, robust.objective) for n in ("tukey", "cauchy", "huber", "least_squares") for k, s in enumerate((1.0, 16.0))]).first().asDict()
    assert row["weight_tukey_0"] == 0 and row["weight_tukey_1"] == 0.5625 and row["weight_cauchy_1"] == 0.8
    assert row["weight_huber_0"] == 0.5 and row["weight_huber_1"] == 1 and row["objective_huber_1"] == 2
    assert row["objective_tukey_0"] == 1 and row["objective_least_squares_0"] == 4 and row["sqrt_weight_huber_0"] == pytest.approx(math.sqrt(0.5))
    with pytest.raises(ValueError):
        robust.weight("none", F.lit(1), F.lit(1))
    assert robust.ransac_rounds(0.99, 0.5, 4, 1000) == 72 and robust.ransac_rounds(0.99, 1.0, 4, 50) == 50 and robust.ransac_rounds(0.99, 0.0, 4, 50) == 1


def test_cameras_invert(spark):
    camera = geometry.FieldOfViewCamera(w=0.9)
    df = spark.createDataFrame([(x / 5, y / 5) for x in range(-3, 4) for y in range(-3, 4)], "x double, y double")
    u, v, _ = camera.project(F.col("x"), F.col("y"))
    back = df.select("x", "y", u.alias("u"), v.alias("v")).select("x", "y", *[c.alias(n) for c, n in zip(camera.unproject(F.col("u"), F.col("v")), ("bx", "by"))])
    assert all(abs(r.x - r.bx) < 1e-3 and abs(r.y - r.by) < 1e-3 for r in back.collect())
    e = 1e-6
    d = camera.derivatives(F.lit(0.3), F.lit(-0.2))
    p = lambda x, y: camera.project(F.lit(x), F.lit(y))
    numeric = [(p(0.3 + e, -0.2)[0] - p(0.3 - e, -0.2)[0]) / (2 * e), (p(0.3, -0.2 + e)[0] - p(0.3, -0.2 - e)[0]) / (2 * e), (p(0.3 + e, -0.2)[1] - p(0.3 - e, -0.2)[1]) / (2 * e), (p(0.3, -0.2 + e)[1] - p(0.3, -0.2 - e)[1]) / (2 * e)]
    row = spark.range(1).select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate([*d, *numeric])]).first()
    assert np.allclose(row[:4], row[4:], atol=1e-4)


def test_small_matrices(spark):
    m = [[2.0, 1.0, 0.5], [0.0, 3.0, 1.0], [1.0, 0.0, 4.0]]
    cells = geometry.inverse3([[F.lit(x) for x in row] for row in m])
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(sum(cells, []))], geometry.det3([[F.lit(x) for x in r] for r in m]).alias("d")).first()
    assert np.allclose(np.array(row[:9]).reshape(3, 3) @ np.array(m), np.eye(3)) and row.d == pytest.approx(np.linalg.det(m))
    two = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(geometry.inverse2(*[F.lit(float(x)) for x in (1, 2, 3, 5)]))], geometry.angle_apart(F.lit(350), F.lit(10)).alias("a"), geometry.zero_mean_squared_apart(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(2.0), F.lit(4.0))).alias("z")).first()
    assert np.allclose(two[:4], np.linalg.inv([[1, 2], [3, 5]]).ravel()) and two.a == 20 and two.z == 0


def test_range_joins_match_all_pairs(spark):
    rng = random.Random(5)
    a = [(k, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(200)]
    df = spark.createDataFrame(a, "id long, x double, y double")
    want = {(p[0], q[0]) for p in a for q in a if math.dist(p[1:], q[1:]) <= 4}
    assert {(r.l_id, r.r_id) for r in spatial.within(df, df, 4.0, "id", "id").collect()} == want
    few = df.where("id < 20")
    hit = {p for p, q in want if q < 20}
    assert {r.id for r in spatial.near_semi(df, few, 4.0, "id", "id").collect()} == hit
    assert {r.id for r in spatial.near_anti(df, few, 4.0, "id", "id").collect()} == set(range(200)) - hit
    with pytest.raises(ValueError):
        spatial.within(df, df, 0, "id", "id")


def test_predicted_corners(spark):
    corners = spark.createDataFrame([(1, 10.0, 10.0), (2, 21.0, 10.0)], "id long, x double, y double")
    wanted = spark.createDataFrame([("a", 20.0, 10.0), ("b", 15.0, 10.0)], "key string, x double, y double")
    assert [(r.key, r.id) for r in spatial.predicted_corner(wanted, corners, "id", 10.0).collect()] == [("a", 2)]


def test_dense_ids_have_no_gaps(spark):
    df = spark.createDataFrame([(k * 7 % 501,) for k in range(1000)], "k long")
    rows = sorted((r.k, r.n) for r in graph.dense_ids(df, "k", "n").collect())
    assert [n for _, n in rows] == list(range(len(rows)))


def test_broadcasts_are_checked(spark):
    assert "broadcast" in small(spark.range(10))._jdf.queryExecution().toString().lower()
    assert "broadcast" not in small(spark.range(1000), 100)._jdf.queryExecution().toString().lower()


def test_nan_positions_and_bad_points(spark):
    df = spark.createDataFrame([(1, float("nan"), 2.0, 3.0)], "id long, x double, y double, z double")
    assert tuple(graph.clean_nan(df).first()) == (1, 0.0, 2.0, 3.0)
    points = spark.createDataFrame([(1, 5, 21), (2, 30, 25), (3, 0, 20)], "point long, n_in long, n_out long")
    assert [r.point for r in graph.bad_points(points).collect()] == [1]


# ---------------------------------------------------------------- kernels

FOUR = np.array([[-0.1022, -0.0301, 4.1363, 299.2137, 241.6603], [-0.2414, -0.1649, 5.0774, 289.9707, 243.2043], [0.3192, 0.6277, 3.7859, 380.2188, 250.2269], [0.3129, 1.0933, 3.8865, 415.6873, 280.7734]])


def test_quartics():
    rng = np.random.default_rng(0)
    for _ in range(200):
        roots = rng.normal(size=4) + 1j * rng.normal(size=4) * (rng.random() < 0.5)
        c = np.poly(roots) * rng.uniform(0.5, 2)
        got = pose.quartic_roots(c)
        assert np.abs(np.polyval(c, got)).max() < 1e-6 * max(1, np.abs(c).max())
    assert sorted(pose.quartic_roots(np.array([1, 0, -5, 0, 4])).real.round(9)) == [-2, -1, 1, 2]
    assert pose.cube_root(-8) == pytest.approx(1 + math.sqrt(3) * 1j)


def test_rigid_motions_invert():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.append(rng.normal(size=3), rng.normal(size=3) * rng.choice([1e-10, 0.1, 1.0]))
        r, t = pose.se3_exp(x)
        assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) == pytest.approx(1)
        assert np.allclose(pose.se3_exp(pose.se3_log(r, t))[0], r, atol=1e-6) and np.allclose(pose.se3_exp(pose.se3_log(r, t))[1], t, atol=1e-5)


def test_four_known_correspondences():
    r, t = pose.se3_exp(np.array([0.1, 0.1, 1.0, 0.0, 0.0, 0.9]))
    world_r, world_t = r.T, -r.T @ t
    got = pose.four_point(FOUR[:, :3], FOUR[:, 3:], pose.PoseParams())
    assert got is not None and np.abs(pose.reprojected(*got, FOUR[:, :3], 300, (320, 240)) - FOUR[:, 3:]).max() < 1
    assert min(np.abs(got[0] - world_r).max() + np.abs(got[1] - world_t).max(), np.abs(got[0] - r).max() + np.abs(got[1] - t).max()) < 0.05


@pytest.mark.parametrize("progressive", [False, True])
def test_consensus_survives_outliers(progressive):
    rng = np.random.default_rng(2)
    r, t = pose.se3_exp(np.array([0.1, 0.1, 1.0, 0.0, 0.0, 0.9]))
    points = np.column_stack([rng.uniform(-1, 1, (150, 2)), rng.uniform(3, 6, 150)])
    p = pose.PoseParams()
    pixels = pose.reprojected(r, t, points, p.focal, p.centre) + rng.normal(0, 0.5, (150, 2))
    pixels[100:] += rng.uniform(50, 200, (50, 2))
    got, inliers = pose.ransac(points, pixels, p, np.arange(150) if progressive else None)
    assert inliers[:100].mean() > 0.9 and inliers[100:].sum() <= 3
    fine = pose.refine(got, points[inliers], pixels[inliers], p)
    assert np.abs(fine[0] - r).max() < 0.01 and np.abs(fine[1] - t).max() < 0.05
    assert pose.ransac(points[:3], pixels[:3], p)[0] is None


def test_triangulation_and_planes():
    r, t = pose.se3_exp(np.array([0.5, 0.1, 0, 0, 0.2, 0]))
    x = np.array([0.3, -0.2, 4.0])
    a = r @ x + t
    assert np.allclose(pose.triangulate(r, t, a[:2] / a[2], x[:2] / x[2]), x)
    rng = np.random.default_rng(3)
    plane = np.column_stack([rng.uniform(-1, 1, (60, 2)), np.zeros(60)])
    n, off, inliers = pose.dominant_plane(np.vstack([plane, rng.uniform(1, 2, (20, 3))]))
    assert abs(n[2]) > 0.999 and abs(off) < 1e-6 and inliers.sum() == 60
    with pytest.raises(ValueError):
        pose.dominant_plane(np.array([[0.0, 0, 0], [1, 0, 0], [2, 0, 0]]))


@pytest.mark.parametrize("estimator", ["tukey", "cauchy", "huber"])
def test_bundles_come_back(estimator):
    rng = np.random.default_rng(4)
    points = np.column_stack([rng.uniform(-1, 1, (30, 2)), rng.uniform(3, 6, 30)])
    cameras = [(*pose.se3_exp(np.array([0.3 * k, 0.1 * k, 0, 0, 0.05 * k, 0])), k < 2) for k in range(4)]
    measured = np.array([(c, k, *((x := r @ points[k] + t)[:2] / x[2])) for c, (r, t, _) in enumerate(cameras) for k in range(30)])
    off = [(r, t, f) if f else (r, t + 0.01, f) for r, t, f in cameras]
    b = pose.Bundle(off, points + rng.normal(0, 0.01, points.shape), measured)
    b.solve(estimator)
    assert np.abs(b.points - points).max() < 1e-3


def test_pairs_of_frames_of_a_crowded_point(spark):
    from bitloom.operators import graph

    edges = [(f, 1) for f in range(60)] + [(f, 2) for f in range(0, 60, 7)] + [(3, 3)]
    df = spark.createDataFrame(edges, "frame long, point long")
    want = sorted((p, j, k) for j, p in edges for k, q in edges if p == q and j < k)
    assert sorted(map(tuple, graph.covisible(df, block=8).collect())) == want == sorted(map(tuple, graph.covisible(df).collect()))
