"""Connected components of an undirected graph given as rows (a long, b long)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import cut, drop, frequent, join_hot


class Forest:
    """Disjoint sets over integers; links: the joins that were not already implied."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        up = self.up
        root = x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.up.setdefault(min(x, y), min(x, y))
            self.links.append((a, b))


#: Distinct nodes that one task's forest holds before it hands on what it has.
FOREST_NODES = 500_000


def _thin(batches):
    """Each task's links cut to a forest of stars, so that hubs and repeats don't travel."""

    def stars(forest: Forest):
        nodes = [x for x in forest.up if forest.top(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.top(x) for x in nodes], pa.int64())], names=["a", "b"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        if len(forest.up) > FOREST_NODES:
            yield stars(forest)
            forest = Forest()
    if forest.up:
        yield stars(forest)


def _to_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """rows (a, b) with m, the least node by a. Of the n edges frequent centres have over a 1,000th each, so their minima
    are few and go to the rows, which no task then gathers; the other centres' rows are shuffled."""
    return join_hot(rows, least.select("a", "m"), "a", least.where(F.col("rows") > frequent(n)))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes; each round is written to the shared folder and the
    one before it deleted. A round's rows never outnumber the edges, and no neighbourhood is gathered: minima are
    aggregated before they are shuffled, and frequent centres get theirs by broadcast.
    """
    state_of = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    e = cut(edges.where("a != b").mapInArrow(_thin, "a long, b long").distinct())
    state, before = state_of(e), None
    while state != before and state.n:
        before, n = state, 2 * state.n
        # large star: every larger neighbour of a node is linked to the least of the node and its neighbours
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("rows")))
        large = cut(_to_least(both.where("b > a"), least, n).select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: every node and its smaller neighbours are linked to the least of them
        lower = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows")))
        small = _to_least(large, lower, n).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(small.union(lower.select("a", F.col("m").alias("b"))).where("a != b").mapInArrow(_thin, "a long, b long").distinct())
        drop(e, least, large, lower)
        e, state = new, state_of(new)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
