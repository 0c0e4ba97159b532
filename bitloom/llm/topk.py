"""Exact top-k by integer inner product.

Vectors are turned into integers, sorted by falling length once and written in that order. A rotation, fitted by SVD on a
bounded sample, moves most of the product into the first coordinates: the partial product over those plus the product of
the residual lengths (by Cauchy-Schwarz) bounds the whole, and only pairs whose bound reaches the query's k-th best score
are multiplied out. The k-th best starts from the longest vectors of all, so every task prunes from its first row, a task
stops at the first row that is too short for all of its queries, and files of shorter rows aren't read at all. Where the
bounds leave many pairs, a block of pairs is multiplied out at once, and only scores that reach the k-th best go on.

Queries are broadcast, in as few parts as a bound on their bytes allows: one part, and so one pass over the vectors, for
up to some 100,000 queries. Candidates are shuffled once, for their order, however many queries there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.llm.common import cut, hold


@dataclass(frozen=True)
class Params:
    """head: rotated coordinates of the partial product. seeds: longest vectors; sample: rows the rotation is fitted on.

    part_bytes: size of the queries that are broadcast at a time; query_block, rows: queries and candidates whose bounds
    are held at a time; dense, patience: the share of pairs above which bounds give way to whole products, and for how
    many blocks they aren't tried again.
    """

    k: int = 5
    every: int = 50
    scale: int = 256
    head: int = 16
    seeds: int = 2048
    sample: int = 4096
    part_bytes: int = 64 << 20
    query_block: int = 2048
    rows: int = 1024
    dense: float = 0.01
    patience: int = 63


#: Integer products of vectors whose lengths multiply to less are exact in 32-bit floats, summed in any order: by
#: Cauchy-Schwarz no sum of some of their terms is larger.
NARROW = 2**24
#: Answers that are gathered before they are sorted in, at least.
PENDING = 200_000


def integers(column: pa.Array, scale: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows of floor(scale * x)) of the usable vectors; shorter ones are filled up with zeros to dim."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), sizes)
    good = valid.copy()
    good[owner[~np.isfinite(flat)]] = False
    out = np.zeros((len(column), dim))
    if len(flat):
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        use = good[owner] & (place < dim)
        out[owner[use], place[use]] = np.floor(scale * flat[use])
    at = np.nonzero(good)[0]
    return at, out[at]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products of integer-valued rows, exactly: in floating point or int64 where that is exact, else in Python's
    integers. A product beyond int64 is an error."""
    reach = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if reach < 2**52:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if reach < 2**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in zip(a, b)], np.int64)


class Best:
    """The k best (score, id) so far of each query, and its floors: a row is of use if it scores more than the floor, or
    as much with an id no larger than that of the floor."""

    def __init__(self, score: np.ndarray, ident: np.ndarray, k: int) -> None:
        self.score, self.id, self.k = score.copy(), ident.copy(), k
        self.held = [(np.zeros(0, np.int64),) * 3]
        self.fresh = 0

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in answers to queries; they are sorted in when they are as many as those that are held."""
        kept = (scores > self.score[q]) | (scores == self.score[q]) & (ids <= self.id[q])
        self.held.append((q[kept], scores[kept], ids[kept]))
        self.fresh += int(kept.sum())
        if self.fresh > max(PENDING, len(self.held[0][0])):
            self.settled()

    def settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, scores, ids) of the k best, sorted; the floors rise to the last of each full k."""
        q, s, i = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        at, score, ident = q[last], s[last], i[last]
        up = (score > self.score[at]) | (score == self.score[at]) & (ident < self.id[at])
        self.score[at[up]], self.id[at[up]] = score[up], ident[up]
        self.held, self.fresh = [(q[rank < self.k], s[rank < self.k], i[rank < self.k])], 0
        return self.held[0]


class Search:
    """A block of queries with rotation and floors; feed() is given rows and keeps each query's k best."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, rotation: np.ndarray, p: Params) -> None:
        self.ids, self.rows, self.rotation, self.p = ids, rows, rotation, p
        turned = rows @ rotation
        self.turned = turned[:, : p.head]
        self.rest = np.sqrt((turned[:, p.head :] ** 2).sum(1))
        self.length = np.sqrt((rows**2).sum(1))
        self.floor_score = np.full(len(ids), np.iinfo(np.int64).min)
        self.floor_id = np.full(len(ids), np.iinfo(np.int64).max)
        self.narrow, self.wait = None, 0

    def start(self) -> Best:
        return Best(self.floor_score, self.floor_id, self.p.k)

    def feed(self, best: Best, ids: np.ndarray, rows: np.ndarray) -> bool:
        """Merge rows into best.

        Rows come by falling length, so the first run of them that no query can use ends it. Tells whether the first run
        was of use; if not, no later row is.
        """
        p = self.p
        length = np.sqrt((rows**2).sum(1))
        order = np.argsort(-length, kind="stable")
        for s in range(0, len(order), p.rows):
            part = order[s : s + p.rows]
            reach = self.length * length[part[0]]
            every = np.nonzero(~(reach * (1 + 1e-9) + 1e-6 < best.score))[0]
            if not len(every):
                return s > 0
            some = Block(rows[part], self, bool(reach.max() < NARROW))
            first = ids[part].min()
            for at in range(0, len(every), p.query_block):
                live = every[at : at + p.query_block]
                # where all ids are larger than the floor's, an equal score is of no use
                floor = best.score[live] + (best.id[live] < first)
                q, r = self._promising(live, some, floor, reach[live])
                q, r = live[q], part[r]
                own = ids[r] == self.ids[q]
                q, r = q[~own], r[~own]
                for t in range(0, len(q), 100_000):
                    qq, rr = q[t : t + 100_000], r[t : t + 100_000]
                    best.add(qq, exact(self.rows[qq], rows[rr]), ids[rr])
        return True

    def _promising(self, live: np.ndarray, some: Block, floor: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in live, places in the block) of all pairs that may score as much as the floor, and few others.

        By partial products and Cauchy-Schwarz; where these leave more than p.dense of the pairs, as on vectors without
        long directions, by whole products, and the next p.patience blocks at once by those.
        """
        p = self.p
        floor = floor.astype(some.kind)
        if self.wait:
            self.wait -= 1
        else:
            bound = self._side(0, some.kind)[live] @ some.bounds().T
            slack = (p.head + 8) * 2.0**-22 * reach if some.kind is np.float32 else 1e-9 * reach
            low = bound < (floor - slack - 1e-6).astype(some.kind)[:, None]
            if low.size - np.count_nonzero(low) <= p.dense * low.size:
                return np.divmod(np.flatnonzero(~low), low.shape[1])
            self.wait = p.patience
        product = self._side(1, some.kind)[live] @ some.rows.T
        least = floor if some.kind is np.float32 else floor - 1e-9 * reach - 1e-6
        return np.divmod(np.flatnonzero(~(product < least[:, None])), product.shape[1])

    def _side(self, which: int, kind: type) -> np.ndarray:
        """The queries' turned coordinates with the lengths of their rests (0), or their rows (1), as numbers of this kind."""
        if self.narrow is None or self.narrow[0] is not kind:
            self.narrow = kind, np.column_stack([self.turned, self.rest]).astype(kind), self.rows.astype(kind)
        return self.narrow[1 + which]

    def settle(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take the k-th best among these rows as every query's floor."""
        best, done, take = self.start(), 0, 32
        while done < len(ids):
            # few first, so that later ones meet a floor
            self.feed(best, ids[done : done + take], rows[done : done + take])
            best.settled()
            done, take = done + take, 2 * take
        self.floor_score, self.floor_id, self.narrow = best.score, best.id, None


class Block:
    """Rows to be held against queries: in 32-bit floats where all partial sums of products are exact in these."""

    def __init__(self, rows: np.ndarray, asked: Search, narrow: bool) -> None:
        self.kind = np.float32 if narrow else np.float64
        self.whole, self.asked, self.rows = rows, asked, rows.astype(self.kind)

    def bounds(self) -> np.ndarray:
        """Turned coordinates and the length of the rest; made when first asked for."""
        if self.whole is not None:
            turned, head = self.whole @ self.asked.rotation, self.asked.p.head
            self.turned, self.whole = np.column_stack([turned[:, :head], np.sqrt((turned[:, head:] ** 2).sum(1))]).astype(self.kind), None
        return self.turned


def search(vectors: DataFrame, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of every query, a row whose id divides by `every`, the k best other rows.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. Shorter vectors
    count as filled up with zeros. Of several query rows with one id the first by components asks, and none of them
    answers it; other repeated rows are candidates of their own. A score beyond 64 bits is an error. An empty table, or
    one without queries, gives no rows; other columns don't matter, whatever their names.
    """
    p = params
    spark = vectors.sparkSession
    table = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    table = table.where("id is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(p.scale * x).cast("double") * F.floor(p.scale * x).cast("double"))
    # equal lengths are told apart by id, so that vectors of one length are dealt to many tasks
    table = cut(table.withColumn("square", square).repartitionByRange(F.desc("square"), "id").sortWithinPartitions(F.desc("square"), "id"))
    asks = F.col("id") % p.every == 0
    sized = table.agg(F.max(F.size("v")).alias("dim"), F.sum(asks.cast("long")).alias("asked")).first()
    dim, asked = int(sized.dim or 0), int(sized.asked or 0)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not dim or not asked:
        return empty

    def rows_of(frame):
        got = frame.select("id", "v").toArrow()
        at, rows = integers(got.column("v"), p.scale, dim)
        return got.column("id").to_numpy()[at].astype(np.int64), rows

    seed_ids, seeds = rows_of(table.orderBy(F.desc("square"), "id").limit(p.seeds))
    _, sample = rows_of(table.orderBy(F.xxhash64("id"), "id").limit(p.sample))
    rotation = np.linalg.svd(sample, full_matrices=True)[2].T if len(sample) >= dim and np.isfinite(sample @ sample.T).all() else np.eye(dim)
    parts = -(-asked * 8 * (dim + p.head) // p.part_bytes)
    queries = table.where(asks).groupBy("id").agg(F.min("v").alias("v")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(parts)))
    queries = cut(queries.repartition("part")) if parts > 1 else queries
    found = []
    for b in range(parts):
        ids, rows = rows_of(queries.where(F.col("part") == b))
        if len(ids):
            one = _part(table, Search(ids, rows, rotation, p), seed_ids, seeds, dim)
            found.append(cut(one) if parts > 1 else one)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def _part(table: DataFrame, asked: Search, seed_ids: np.ndarray, seeds: np.ndarray, dim: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of every partition, and maybe more; table: id, v and square, sorted."""
    asked.settle(seed_ids, seeds)
    take = hold(table.sparkSession, asked)
    scale = asked.p.scale
    # the shortest vector that any query has use for; readers skip files and row groups of shorter ones
    with np.errstate(divide="ignore", invalid="ignore"):
        need = float(np.min(np.where(asked.floor_score > 0, asked.floor_score / asked.length, 0)))
    live = table.where(F.col("square") >= (need * (1 - 1e-9)) ** 2 - 1e-6) if np.isfinite(need) and need > 0 else table

    def run(batches):
        s = take()
        best, more = s.start(), True
        for batch in batches:
            if more:
                at, rows = integers(batch.column(1), scale, dim)
                more = s.feed(best, batch.column(0).to_numpy()[at].astype(np.int64), rows)
        q, scores, ids = best.settled()
        yield pa.RecordBatch.from_arrays([pa.array(s.ids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    return live.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score long")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
