"""Queries without SQL, held against plain loops over the same tables; and how many neighbours the approximate ones find."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from bitloom.operators import images, search
from bitloom.plans import registry, searches

DIR = "/root/testdata/sf0.001"
ALL = [d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1") if os.path.isdir(d)]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def run(spark, name, place=DIR):
    return registry.queries()[name](spark, place).collect()


def embeddings(spark):
    return {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}


def events(spark):
    quality = {"error": "BAD", "click": "GOOD", "purchase": "GOOD"}
    out = defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/events.parquet").orderBy("user_id", "event_id").collect():
        out[r.user_id].append((r.event_id, quality.get(r.event_type, "DODGY"), r.value))
    return out


@pytest.mark.parametrize("place", ALL)
@pytest.mark.parametrize("name", ["lsh_ann", "lsh_multiprobe", "cluster_pruned_nn"])
def test_approximate_searches_find_nine_in_ten(spark, place, name):
    exact = {(r.q_id, r.m_id) for r in run(spark, "nn_exact_ties", place)}
    found = {(r.q_id, r.m_id) for r in run(spark, name, place)}
    assert len(exact & found) >= 0.9 * len(exact)


def test_tables_are_sized_for_the_rows():
    for rows in (500, 2_000, 1_000_000, 10**9):
        p = search.LshParams.for_rows(rows)
        assert rows / 2**p.bits <= 8 and p.tables >= 1
    assert search.LshParams.for_rows(2_000) == searches.LSH


def test_key_frames(spark):
    want = []
    for key, frames in events(spark).items():
        motion, lost, last = 0.0, 0, None
        for seq, quality, value in frames:
            motion = 0.9 * (0.5 * value + 0.5 * motion)
            lost = lost + 1 if quality == "BAD" else 0
            if quality == "GOOD" and (last is None or abs(value - last[1]) > 10 and seq - last[0] > 20):
                last = (seq, value)
                want.append((key, seq, motion, lost))
    assert sorted(map(tuple, run(spark, "keyframe_policy"))) == sorted(want) and want


def test_motion_remembers_everything(spark):
    from bitloom.streaming import frames as fr

    values = [1e9] + [1e-9] * 200
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "key long, seq long, value double").selectExpr("*", "'GOOD' as quality", "cast(null as timestamp) as ts")
    motion, want = 0.0, []
    for v in values:
        motion = 0.9 * (0.5 * v + 0.5 * motion)
        want.append(motion)
    assert [r.motion for r in fr.motion_table(df).orderBy("seq").collect()] == want


def test_tracking_as_a_stream_is_tracking(spark):
    want = []
    for key, frames in events(spark).items():
        motion, lost, last = 0.0, 0, None
        for seq, quality, value in frames:
            motion, lost = 0.9 * (0.5 * value + 0.5 * motion), lost + 1 if quality == "BAD" else 0
            key_frame = quality == "GOOD" and (last is None or abs(value - last[1]) > 10 and seq - last[0] > 20)
            last = (seq, value) if key_frame else last
            want.append((key, seq, motion, lost, lost >= 6, key_frame))
    assert sorted(map(tuple, run(spark, "stream_tracking"))) == sorted(want)


def test_closed_windows(spark):
    rows = spark.read.parquet(f"{DIR}/events.parquet").selectExpr("cast(unix_timestamp(cast(ts as timestamp)) as long) as t", "event_type", "value").collect()
    quality = {"error": "BAD", "click": "GOOD", "purchase": "GOOD"}
    n, total = Counter(), defaultdict(float)
    for r in rows:
        k = (r.t // 86400, quality.get(r.event_type, "DODGY"))
        n[k] += 1
        total[k] += r.value
    got = run(spark, "stream_windows")
    for r in got:
        k = (int(r.start.timestamp()) // 86400, r.quality)
        assert r.n == n[k] and r.value == pytest.approx(total[k])


def test_hash_functions_fill_their_tables(spark):
    bits = {i: (v > 0).astype(int) for i, v in embeddings(spark).items()}
    rows = np.array(list(bits.values()))
    rng = random.Random(1)
    made = {"uniform": rng.sample(range(64), 8), "stable": search.weighted_function(rng, [k / 64 for k in range(64)], 8)}
    c = np.corrcoef(rows.T)
    for most in (False, True):
        for soft in (False, True):
            chosen = [0]
            while len(chosen) < 8:
                total = np.round(np.abs(c[:, chosen]).sum(1), 9)
                rest = [k for k in np.argsort(-total if most else total, kind="stable").tolist() if k not in chosen]
                chosen.append(rng.choice(rest[: max(1, math.ceil(len(rest) / 10))]) if soft else rest[0])
            made[f"{'most' if most else 'least'}_{'soft' if soft else 'hard'}"] = chosen
    got = {r["mode"]: (r.n_buckets, r.largest) for r in run(spark, "hash_functions")}
    for mode, f in made.items():
        filled = Counter(tuple(r) for r in rows[:, f].tolist())
        assert got[mode] == (len(filled), max(filled.values())), mode


def test_clusters_by_plain_rounds(spark):
    """The last round of the query's clusters: majority votes of their own rows, and rows with their nearest centroid."""
    rows = np.array([(v > 0).astype(int) for v in embeddings(spark).values()])
    got = run(spark, "kbm_cluster")
    centroids = np.array([[(w >> k) & 1 for w in (r.w0, r.w1) for k in range(32)] for r in sorted(got)])
    apart = (rows[:, None, :] != centroids[None]).sum(2)
    cost = apart.min(1).mean()
    for _ in range(3):
        nearest = apart.argmin(1)
        centroids = np.array([(rows[nearest == c].sum(0) > (nearest == c).sum() // 2).astype(int) for c in range(len(centroids))])
        apart = (rows[:, None, :] != centroids[None]).sum(2)
    assert cost - apart.min(1).mean() < 0.2 and sum(r.n for r in got) == len(rows)
    sweep = {r.k: r for r in run(spark, "kbm_sweep")}
    assert sum(sweep[8].sizes) == len(rows) and sweep[8].cost < sweep[4].cost


def test_corners_and_saddles_pixel_by_pixel(spark):
    corners, saddles = set(), set()
    for i, v in embeddings(spark).items():
        image = (v * 1000).reshape(8, 8)
        for y in range(3, 5):
            for x in range(3, 5):
                gx = [image[y + j, x + k + 1] - image[y + j, x + k - 1] for j in range(-2, 3) for k in range(-2, 3)]
                gy = [image[y + j + 1, x + k] - image[y + j - 1, x + k] for j in range(-2, 3) for k in range(-2, 3)]
                m = np.array([[np.dot(gx, gx), np.dot(gx, gy)], [np.dot(gx, gy), np.dot(gy, gy)]]) / 50
                if np.linalg.eigvalsh(m)[0] > 70:
                    corners.add((i, x, y))
                ring = [image[y + dy, x + dx] for dx, dy in images.RING]
                mean = sum(ring) / 16
                sides = [1 if r > mean else -1 for r in ring if abs(r - mean) > 20]
                if abs(image[y, x] - mean) < 20 and sum(a != b for a, b in zip(sides, sides[1:] + sides[:1])) == 4:
                    saddles.add((i, x, y))
    assert {(r.id, r.x, r.y) for r in run(spark, "corner_scores")} == corners and corners
    assert {(r.id, r.x, r.y) for r in run(spark, "saddle_corners")} == saddles and saddles


def test_directions_and_fits_image_by_image(spark):
    each = embeddings(spark)
    angles = {r.id: r.angle for r in run(spark, "best_directions")}
    fits = {r.id: (r.x, r.y) for r in run(spark, "sub_pixel_fits")}
    assert set(angles) == set(fits) == set(each)
    for i in list(each)[:40]:
        image = (each[i] * 1000).reshape(8, 8)
        gy, gx = np.zeros((8, 8)), np.zeros((8, 8))
        gx0, gy0 = images.gradients(image)
        best = max(np.arange(0, math.pi, 0.1), key=lambda a: round(sum(abs(-math.sin(a) * images.sample(gx0, 3.5 + t * math.cos(a), 3.5 + t * math.sin(a)) + math.cos(a) * images.sample(gy0, 3.5 + t * math.cos(a), 3.5 + t * math.sin(a))) for t in np.linspace(-3, 3, 9)), 9))
        assert angles[i] == pytest.approx(best)
    settled = [f for f in fits.values() if f[0] is not None]
    assert len(settled) > 100 and np.mean([math.hypot(x - 3.5, y - 3.5) < 0.1 for x, y in settled]) > 0.7


def test_recovery_records(spark):
    poses = {r.frame: r for r in run(spark, "pose_prosac") if r.found}
    got = {r.frame: r for r in run(spark, "recovery_records")}
    assert set(got) == set(poses) and got
    for frame, r in got.items():
        assert (r.query_size, r.inliers, r.n_points) == (poses[frame].n, poses[frame].inliers, poses[frame].inliers)
        assert [r[f"p{k}"] for k in range(12)] == pytest.approx(poses[frame].pose)
        assert 0 <= r.t_prep <= r.t_reloc and 0 < r.t_pair <= r.t_reloc and 0 < r.map_size <= r.query_size


def test_an_index_of_another_size_is_told(spark, tmp_path):
    from bitloom.sources import text

    index = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "word long, image_id long, tf long")
    text.load_or_build_index(spark, str(tmp_path / "i"), lambda: index, 2)
    with pytest.warns(UserWarning, match="2 images, not 3"):
        assert text.load_or_build_index(spark, str(tmp_path / "i"), None, 3).count() == 2
