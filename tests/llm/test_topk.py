import random

import pytest
from pyspark.sql import functions as F

from bitloom.llm import topk

V = "vec_id long, embedding array<float>, label int"


def plain(rows, k=5, every=50):
    import math

    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], {}
    for i, v in sorted(use):
        if i % every == 0:
            asked.setdefault(i, v)
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in use if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(df, **params):
    return sorted(tuple(r) for r in topk.search(df, topk.Params(**params)).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    import struct

    f = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    out = [(k, [f(rng.gauss(0, 0.2)) for _ in range(12)]) for k in range(700)]
    out += [(k, [0.5] * 12) for k in range(700, 900)]
    return out + [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (904, []), (950, [0.25] * 5), (951, [0.5] * 3), (10, [0.5] * 12), (50, [-0.5] * 12)]


@pytest.mark.parametrize("params", [{}, {"head": 2, "rows": 7}, {"seeds": 3, "sample": 5}, {"query_block": 3}, {"part_bytes": 500}, {"part_bytes": 500, "head": 2, "seeds": 3}, {"every": 7}, {"k": 1}])
def test_all_pairs(spark, rows, params):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], V).repartition(5).withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    assert run(df, **params) == plain(rows, params.get("k", 5), params.get("every", 50))


def test_few_rows(spark):
    assert run(spark.createDataFrame([], V)) == []
    assert run(spark.createDataFrame([(0, [1.0, 2.0], 0)], V)) == []
    assert run(spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0], 0)], V)) == [(0, 1, 1, 65536)]
    assert run(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], V)) == []
    assert run(spark.createDataFrame([(0, None, 0)], V)) == []


def test_scores_of_any_size_are_exact(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([1e4, -3e6, 12345.5, 7e5]) * rng.random() for _ in range(8)]) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(df) == plain(rows)
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        run(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>"))


def test_vectors_of_one_length(spark):
    rows = [(k, [1.0 if j == k % 6 else 0.0 for j in range(6)]) for k in range(300)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)) == plain(rows)


def test_pruning_does_prune():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(0, 1, (5000, 32)) * np.exp(-np.arange(32) / 6) * 256)
    p = topk.Params()
    s = topk.Search(np.arange(20), rows[:20], np.linalg.svd(rows)[2].T, p)
    s.settle(np.arange(1000, 3000), rows[1000:3000])
    reach = (s.turned @ (rows @ s.rotation)[:, : p.head].T) + s.rest[:, None] * np.sqrt(((rows @ s.rotation)[:, p.head :] ** 2).sum(1))
    assert (reach >= s.floor_score[:, None]).mean() < 0.02


def test_few_pairs_are_multiplied_one_by_one(monkeypatch):
    """On vectors of one length without long directions no bound prunes; also where many are copies of one another."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = rng.normal(size=(12_000, 64))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None])
    rows[6_000:] = rows[0]
    ids, done, real = np.arange(len(rows)), [], topk.exact
    monkeypatch.setattr(topk, "exact", lambda a, b: done.append(len(a)) or real(a, b))
    s = topk.Search(ids[:200], rows[:200], np.linalg.svd(rows[:4096])[2].T, topk.Params())
    s.settle(ids[:2048], rows[:2048])
    best = s.start()
    for k in range(0, len(rows), 1000):
        s.feed(best, ids[k : k + 1000], rows[k : k + 1000])
    got = best.settled()
    assert sum(done) < 0.03 * 200 * len(rows)
    scores = rows[:200] @ rows.T
    for q in range(200):
        want = [i for i in np.lexsort((ids, -scores[q])) if i != q][:5]
        assert got[2][got[0] == q].tolist() == want and got[1][got[0] == q].tolist() == scores[q][want].astype(int).tolist()
