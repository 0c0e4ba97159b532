"""Queries without SQL that must carry their work to its end."""

import os

import numpy as np
import pandas as pd
import pytest

from bitloom.operators import cluster, pose
from bitloom.plans import kernels, registry, searches

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture
def runs(monkeypatch):
    """What binary_means gives when a query calls it: (centroids, assignment, costs) of each call."""
    out, real = [], cluster.binary_means

    def held(*a, **b):
        out.append(real(*a, **b))
        return out[-1]

    monkeypatch.setattr(cluster, "binary_means", held)
    return out


def ended(costs):
    return len(costs) == 32 or 0 <= costs[-2] - costs[-1] < 1e-5


def test_clusters_are_those_of_the_last_round(spark, runs):
    assert registry.queries()["kbm_cluster"](spark, DIR).count() == 8
    assert [ended(c) for _, _, c in runs] == [True]


def test_the_sweep_clusters_to_the_end_and_gives_sizes(spark, runs):
    rows = sorted(registry.queries()["kbm_sweep"](spark, DIR).collect())
    assert [r.k for r in rows] == [4, 8] and all(ended(c) for _, _, c in runs)
    for r, (_, assigned, costs) in zip(rows, runs):
        sizes = {x.c_id: x["count"] for x in assigned.groupBy("c_id").count().collect()}
        assert (r.sizes, r.cost, r.rounds) == ([sizes.get(c, 0) for c in range(r.k)], costs[-1], len(costs) - 1)
        assert sum(r.sizes) == assigned.count() and r.seconds > 0


def test_a_wrong_point_anywhere_in_a_frame_shows(monkeypatch):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"frame": 1, "x": rng.uniform(-1, 1, 60), "y": rng.uniform(-1, 1, 60)})
    assert kernels.two_view(pdf)["point_error"] < 0.01
    seen, right = [], pose.triangulate

    def wrong(*a):
        seen.append(1)
        return right(*a) + (len(seen) == 45)

    monkeypatch.setattr(pose, "triangulate", wrong)
    assert kernels.two_view(pdf)["point_error"] > 0.9 and len(seen) == 60
