"""Queries on descriptors: the signs of `embeddings`, as 64 bits in two words."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import bits, geometry
from bitloom.operators import cluster, retrieval, search, spatial
from bitloom.operators.sizing import small
from bitloom.plans.registry import query, table

#: For tables of some 2,000 rows, as the largest given ones; a larger table takes for_rows() of its count.
LSH = search.LshParams.for_rows(2_000)
WIDE = search.LshParams(tables=12, bits=8)
PROBES = 7
SPARSE = search.LshParams(tables=1, bits=16, seed=3)


def descriptors(spark, sf_dir) -> DataFrame:
    return bits.with_words(table(spark, sf_dir, "embeddings")).select("vec_id", "label", "w0", "w1")


def asked(df: DataFrame) -> DataFrame:
    """The query set of every search: rows whose id divides by 100, against all rows."""
    return df.where("vec_id % 100 = 0")


# ---------------------------------------------------------------- SQL


def _word(k: int) -> str:
    return f"CAST(list_sum(list_transform(range(0, 32), lambda k: CASE WHEN embedding[k + {32 * k + 1}] > 0 THEN 1::BIGINT << k::BIGINT ELSE 0::BIGINT END)) AS BIGINT)"


_D = f"d AS (SELECT vec_id, label, {_word(0)} AS w0, {_word(1)} AS w1 FROM embeddings)"
_APART = "CAST(bit_count(xor(q.w0, m.w0)) + bit_count(xor(q.w1, m.w1)) AS INTEGER)"
_PAIRS = f"p AS (SELECT q.vec_id AS q_id, m.vec_id AS m_id, {_APART} AS d FROM d q JOIN d m ON q.vec_id <> m.vec_id WHERE q.vec_id % 100 = 0)"


def _hash(positions: list[int]) -> str:
    return "(" + " + ".join(f"(((w{p // 32} >> {p % 32}) & 1) << {i})" for i, p in enumerate(positions)) + ")"


def _buckets(p: search.LshParams, name: str = "b") -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT vec_id, w0, w1, {t} AS tab, CAST({_hash(f)} AS BIGINT) AS hash FROM d" for t, f in enumerate(p.functions())) + ")"


def _met(p: search.LshParams) -> str:
    return f"{_D}, {_buckets(p)}, met AS (SELECT q.vec_id AS q_id, m.vec_id AS m_id, {_APART} AS d, q.tab AS tab FROM b q JOIN b m ON q.tab = m.tab AND q.hash = m.hash AND q.vec_id <> m.vec_id WHERE q.vec_id % 100 = 0), cand AS (SELECT DISTINCT q_id, m_id, d FROM met)"


_TIES = "SELECT q_id, m_id, d FROM (SELECT *, rank() OVER (PARTITION BY q_id ORDER BY d) AS r FROM {0}) WHERE r = 1"
_K = "SELECT q_id, m_id, d, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, m_id) AS r FROM {0}) WHERE r <= 5"


# ---------------------------------------------------------------- exact search


@query("S8 F3 F5 F6", f"WITH {_D} SELECT vec_id, w0, w1, CAST(bit_count(w0) + bit_count(w1) AS INTEGER) AS n_ones, reverse(lpad(bin(w0), 32, '0')) || ' ' || reverse(lpad(bin(w1), 32, '0')) AS bits FROM d")
def descriptor_words(spark, sf_dir):
    w = [F.col("w0"), F.col("w1")]
    return descriptors(spark, sf_dir).select("vec_id", "w0", "w1", bits.popcount(w).alias("n_ones"), bits.rendered(w).alias("bits"))


@query("F1 F2 F4", f"WITH {_D}, {_PAIRS} SELECT q_id, m_id, d FROM p")
def hamming_pairs(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    return search.pairs(asked(df), df)


@query("J1 J3 W1", f"WITH {_D}, {_PAIRS} {_TIES.format('p')}")
def nn_exact_ties(spark, sf_dir):
    return search.nearest_with_ties(hamming_pairs(spark, sf_dir))


@query("J2 J6 J41 W2", f"WITH {_D}, {_PAIRS} {_K.format('p')}")
def knn_exact(spark, sf_dir):
    return search.k_nearest(hamming_pairs(spark, sf_dir), 5)


@query("J3 J7", f"WITH {_D}, f AS (SELECT q.vec_id AS a, m.vec_id AS b, {_APART} AS d FROM d q JOIN d m ON q.vec_id % 100 = 0 AND m.vec_id % 100 <> 0), x AS (SELECT a, b, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) r FROM f) WHERE r = 1), y AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY d, a) r FROM f) WHERE r = 1) SELECT x.a AS q_id, x.b AS m_id, x.d AS d FROM x JOIN y ON x.a = y.a AND x.b = y.b")
def mutual_match(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    return search.mutual(asked(df), df.where("vec_id % 100 != 0")).select("q_id", "m_id", "d")


_PLACED = "v AS (SELECT vec_id, (vec_id * 37 % 61)::DOUBLE AS x, (vec_id * 53 % 67)::DOUBLE AS y FROM embeddings)"


def placed(df: DataFrame) -> DataFrame:
    """df with a place in an image of 61 by 67 pixels."""
    return df.select("*", (F.col("vec_id") * 37 % 61).cast("double").alias("x"), (F.col("vec_id") * 53 % 67).cast("double").alias("y"))


@query(
    "J34",
    f"WITH {_D}, {_PLACED}, f AS (SELECT q.vec_id AS a, m.vec_id AS b, {_APART} AS d FROM d q JOIN d m ON q.vec_id % 100 = 0 AND m.vec_id % 100 <> 0), x AS (SELECT a, b, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) r FROM f) WHERE r = 1), y AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY d, a) r FROM f) WHERE r = 1) "
    "SELECT x.a AS q_id, x.b AS m_id, x.d AS d FROM x JOIN y ON x.b = y.b JOIN v p ON p.vec_id = x.a JOIN v o ON o.vec_id = y.a WHERE sqrt((p.x - o.x)**2 + (p.y - o.y)**2) <= sqrt(2::DOUBLE)",
)
def mutual_match_place(spark, sf_dir):
    df = placed(descriptors(spark, sf_dir))
    return search.mutual_by_place(asked(df), df.where("vec_id % 100 != 0"))


_PATCH = "v AS (SELECT vec_id, (vec_id * 37 % 61)::DOUBLE AS x, (vec_id * 53 % 67)::DOUBLE AS y, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)) AS e FROM embeddings)"
_ZM = "list_sum(list_transform(list_zip(q.e, m.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) - (list_sum(q.e) - list_sum(m.e)) * (list_sum(q.e) - list_sum(m.e)) / 64"
_LEAST = "SELECT q_id, m_id, z AS zmssd FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY z, m_id) r FROM p WHERE z < 3000000) WHERE r = 1"


def _patches(spark, sf_dir) -> DataFrame:
    return placed(table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double")).alias("e")))


def _least_patch(met: DataFrame) -> DataFrame:
    """Of pairs (q_id, q, m_id, e) each query's patch of least difference, if that is below the bound; ties to the smaller id."""
    z = met.select("q_id", "m_id", geometry.zero_mean_squared_apart(F.col("q"), F.col("e")).alias("z")).where("z < 3000000")
    return z.groupBy("q_id").agg(F.min(F.struct("z", "m_id")).alias("b")).select("q_id", F.col("b.m_id").alias("m_id"), F.col("b.z").alias("zmssd"))


@query("J32 J33", f"WITH {_PATCH}, p AS (SELECT q.vec_id AS q_id, m.vec_id AS m_id, {_ZM} AS z FROM v q JOIN v m ON q.vec_id <> m.vec_id AND sqrt((q.x - m.x)**2 + (q.y - m.y)**2) <= 12 WHERE q.vec_id % 100 = 0) {_LEAST}")
def patch_in_window(spark, sf_dir):
    """The patch of least difference among those in a round window, if that is below a bound: a range join, then the least."""
    v = _patches(spark, sf_dir)
    met = spatial.within(asked(v), v, 12.0, "vec_id", "vec_id").where("l_vec_id != r_vec_id")
    return _least_patch(met.select(F.col("l_vec_id").alias("q_id"), F.col("l_e").alias("q"), F.col("r_vec_id").alias("m_id"), F.col("r_e").alias("e")))


@query(
    "J31",
    f"WITH {_PATCH}, g AS (SELECT vec_id, e, x AS ax, y AS ay, 60 - x AS bx, 66 - y AS by2 FROM v WHERE vec_id % 100 = 0), u AS (SELECT *, sqrt((bx - ax)**2 + (by2 - ay)**2) AS l FROM g), q AS (SELECT *, (bx - ax) / l AS ux, (by2 - ay) / l AS uy FROM u WHERE l > 0), "
    f"p AS (SELECT q.vec_id AS q_id, m.vec_id AS m_id, {_ZM} AS z FROM q JOIN v m ON q.vec_id <> m.vec_id AND abs((m.y - ay) * ux - (m.x - ax) * uy) <= 3 AND (m.x - ax) * ux + (m.y - ay) * uy BETWEEN -3 AND l + 3) {_LEAST}",
)
def epipolar_patch(spark, sf_dir):
    """The patch of least difference within a band around each query's segment, if that is below a bound."""
    v = _patches(spark, sf_dir)
    q = asked(v).select("vec_id", "e", F.col("x").alias("ax"), F.col("y").alias("ay"), (60 - F.col("x")).alias("bx"), (66 - F.col("y")).alias("by"))
    near = spatial.in_band(q, v, 3.0, "vec_id", "vec_id").where("segment != point")
    met = near.join(small(q.select(F.col("vec_id").alias("segment"), F.col("e").alias("q"))), "segment").join(v.select(F.col("vec_id").alias("point"), "e"), "point")
    return _least_patch(met.select(F.col("segment").alias("q_id"), "q", F.col("point").alias("m_id"), "e"))


@query("F23 J35", "WITH p AS (SELECT q.vec_id AS q_id, m.vec_id AS m_id, list_sum(list_transform(list_zip(q.embedding, m.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS s FROM embeddings q JOIN embeddings m ON q.vec_id <> m.vec_id WHERE q.vec_id % 100 = 0) SELECT q_id, m_id, round(s, 6) AS ssd FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s, m_id) r FROM p) WHERE r = 1")
def ssd_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = small(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("qv")))
    s = e.join(q, F.col("q_id") != F.col("vec_id")).select("q_id", F.col("vec_id").alias("m_id"), geometry.squared_apart(F.col("qv"), F.col("v")).alias("s"))
    return s.groupBy("q_id").agg(F.min(F.struct("s", "m_id")).alias("b")).select("q_id", F.col("b.m_id").alias("m_id"), F.round("b.s", 6).alias("ssd"))


# ---------------------------------------------------------------- hashing


@query("J8 H1 A20", f"WITH {_D}, {_buckets(LSH)} SELECT tab AS \"table\", count(DISTINCT hash) AS n_buckets, count(*) AS n_elems FROM b GROUP BY tab")
def lsh_buckets(spark, sf_dir):
    return search.bucket_stats(descriptors(spark, sf_dir), LSH)


@query("J4 J9 J10 J11", f"WITH {_met(LSH)} {_TIES.format('cand')}")
def lsh_ann(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    return search.nearest_with_ties(search.lsh_candidates(asked(df), df, LSH))


@query("J4", f"WITH {_met(LSH)} SELECT q_id, count(*) AS n_retrieved FROM cand GROUP BY q_id")
def lsh_retrieved(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    return search.lsh_candidates(asked(df), df, LSH).groupBy("q_id").agg(F.count("*").alias("n_retrieved"))


@query("J5 J7", f"WITH {_met(SPARSE)} SELECT d.vec_id AS q_id, b.m_id AS m_id, b.d AS d FROM d LEFT JOIN (SELECT q_id, m_id, d FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, m_id) r FROM cand) WHERE r = 1) b ON d.vec_id = b.q_id WHERE d.vec_id % 100 = 0")
def nn_left_outer_one(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    return search.one_per_query(asked(df), search.lsh_candidates(asked(df), df, SPARSE))


@query("J14", f"WITH {_met(LSH)} {_K.format('cand')}")
def lsh_knn(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    return search.k_nearest(search.lsh_candidates(asked(df), df, LSH), 5)


@query("J15", f"WITH {_met(LSH)} {_K.format('met')}")
def lsh_knn_dup(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    return search.k_nearest(search.collisions(asked(df), df, LSH).drop("table"), 5).select("q_id", "m_id", "d", "rank")


_MASKS = [bits.support([f], 2) for f in LSH.functions()]
_CASE = [" ".join(f"WHEN {t} THEN {m[k]}" for t, m in enumerate(_MASKS)) for k in (0, 1)]


@query("J12 H7 F9", f"WITH {_met(LSH)}, g AS (SELECT q_id, m_id, d, count(*) AS n_tables, bit_or(CASE tab {_CASE[0]} END::BIGINT) AS b0, bit_or(CASE tab {_CASE[1]} END::BIGINT) AS b1 FROM met GROUP BY ALL) SELECT q_id, m_id, d, n_tables, CAST(bit_count(b0) + bit_count(b1) AS INTEGER) AS support FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, m_id) r FROM g) WHERE r = 1")
def lsh_support(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    return search.lsh_support(asked(df), df, LSH)


@query("A2", f"WITH {_met(LSH)}, g AS (SELECT q_id, m_id, d, count(*) AS n FROM met GROUP BY ALL), best AS (SELECT n FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, m_id) r FROM g) WHERE r = 1) SELECT count(*) AS n_queries, CAST(sum(n) AS BIGINT) AS sum_support, round(avg(n), 9) AS avg_support, round(stddev_samp(n), 9) AS std_support FROM best")
def support_stats(spark, sf_dir):
    s = lsh_support(spark, sf_dir)
    return s.agg(F.count("*").alias("n_queries"), F.sum("n_tables").alias("sum_support"), F.round(F.avg("n_tables"), 9).alias("avg_support"), F.round(F.stddev_samp("n_tables"), 9).alias("std_support"))


_FLIPS = ", ".join(str(1 << k) for k in range(WIDE.bits))
_WIDE = (
    f"{_D}, {_buckets(WIDE)}, c1 AS (SELECT DISTINCT q.vec_id AS q_id, m.vec_id AS m_id, {_APART} AS d FROM (SELECT b.*, unnest([0, {_FLIPS}]) AS flip FROM b WHERE vec_id % 100 = 0) q JOIN b m ON q.tab = m.tab AND m.hash = xor(q.hash, q.flip::BIGINT) AND q.vec_id <> m.vec_id), "
    f"r1 AS ({_TIES.format('c1')}), l1 AS (SELECT * FROM d WHERE vec_id % 100 = 0 AND vec_id NOT IN (SELECT q_id FROM r1)), c2 AS (SELECT q.vec_id AS q_id, m.vec_id AS m_id, {_APART} AS d FROM l1 q JOIN d m ON q.vec_id <> m.vec_id), r2 AS ({_TIES.format('c2')})"
)


@query("J13", f"WITH {_WIDE} SELECT q_id, m_id, d, 1 AS flips FROM r1 UNION ALL SELECT q_id, m_id, d, 2 FROM r2")
def lsh_multiprobe(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    return search.multi_probe(asked(df), df, WIDE, wide=True)


@query("H9", "SELECT CAST(m AS INTEGER) AS tables, CAST(floor(greatest(0.9261::DOUBLE * exp(-0.2317::DOUBLE * m) - 0.2447::DOUBLE, 0)) AS INTEGER) AS low, CAST(ceil(greatest(1.2102::DOUBLE * exp(-0.0540::DOUBLE * m) + 0.0801::DOUBLE, 0)) AS INTEGER) AS high FROM range(1, 61) t(m)")
def support_thresholds(spark, sf_dir):
    """For hash functions of up to 60 tables; no table is read."""
    m = spark.range(1, 61).select(F.col("id").cast("int").alias("tables"))
    low, high = search.support_thresholds(F.col("tables"))
    return m.select("tables", low.alias("low"), high.alias("high"))


@query(
    "J38 A1 A3 A4 K9",
    f"WITH {_met(LSH)}, {_PAIRS}, e AS ({_TIES.format('p')}), a AS ({_TIES.format('cand')}), h AS (SELECT count(*) AS n FROM e JOIN a USING (q_id, m_id)) "
    "SELECT (SELECT count(*) FROM e) AS n_exact, round((SELECT avg(d) FROM e), 9) AS mean_exact, (SELECT count(*) FROM a) AS n_approx, round((SELECT avg(d) FROM a), 9) AS mean_approx, h.n AS n_hit, round(h.n / (SELECT count(*) FROM e), 9) AS recall FROM h",
)
def ann_recall(spark, sf_dir):
    return _recall(spark, sf_dir, lsh_ann)


def _recall(spark, sf_dir, approximate) -> DataFrame:
    r = search.recall(nn_exact_ties(spark, sf_dir), approximate(spark, sf_dir))
    return r.select("n_exact", F.round("mean_exact", 9).alias("mean_exact"), "n_approx", F.round("mean_approx", 9).alias("mean_approx"), "n_hit", F.round("recall", 9).alias("recall"))


@query("A21 H3", "WITH b AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings), s AS (SELECT vec_id, i, CASE WHEN x > 0 THEN 1 ELSE 0 END AS v FROM b) SELECT CAST(a.i AS BIGINT) AS i, CAST(c.i AS BIGINT) AS j, round(corr(a.v, c.v), 6) + 0.0::DOUBLE AS r FROM s a JOIN s c USING (vec_id) GROUP BY ALL")
def bit_correlation(spark, sf_dir):
    c = search.bit_correlation(descriptors(spark, sf_dir), 64)
    return spark.createDataFrame([(i, j, round(float(c[i, j]), 6) + 0.0) for i in range(64) for j in range(64)], "i long, j long, r double")


@query("H2 H4 H5 H6 H10")
def hash_functions(spark, sf_dir):
    """Bits chosen by stability and by correlation, and how the tables that use them fill."""
    import random

    df = descriptors(spark, sf_dir)
    c = search.bit_correlation(df, 64)
    rng = random.Random(1)
    made = {"uniform": rng.sample(range(64), 8), "stable": search.weighted_function(rng, [k / 64 for k in range(64)], 8)}
    for most in (False, True):
        for soft in (False, True):
            made[f"{'most' if most else 'least'}_{'soft' if soft else 'hard'}"] = search.correlated_function(rng, c, 8, 0, most, soft)
    out = None
    for mode, f in made.items():
        one = df.groupBy(bits.gather([F.col("w0"), F.col("w1")], f).alias("h")).count().agg(F.lit(mode).alias("mode"), F.count("*").alias("n_buckets"), F.max("count").alias("largest"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- clusters

_BIT = "SELECT label AS g, k, v FROM (SELECT label, unnest(range(0, 64)) AS k, unnest(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS v FROM embeddings)"


@query("A5 A6 F5", f"WITH s AS (SELECT g, k, CASE WHEN sum(v) > count(*) // 2 THEN 1 ELSE 0 END AS b, count(*) AS n FROM ({_BIT}) GROUP BY g, k) SELECT g AS label, CAST(sum(CASE WHEN k < 32 THEN b::BIGINT << k::BIGINT ELSE 0 END) AS BIGINT) AS w0, CAST(sum(CASE WHEN k >= 32 THEN b::BIGINT << (k - 32)::BIGINT ELSE 0 END) AS BIGINT) AS w1, max(n) AS n FROM s GROUP BY g")
def majority_descriptor(spark, sf_dir):
    return cluster.majority(descriptors(spark, sf_dir), "label", ["w0", "w1"])


_C0 = "c0 AS (SELECT vec_id AS c_id, w0, w1 FROM d WHERE vec_id < 8)"


def _assigned(name: str, centroids: str) -> str:
    return f"{name} AS (SELECT vec_id, w0, w1, c_id, d FROM (SELECT m.vec_id, m.w0, m.w1, q.c_id, {_APART} AS d, row_number() OVER (PARTITION BY m.vec_id ORDER BY {_APART}, q.c_id) AS r FROM d m JOIN {centroids} q ON true) WHERE r = 1)"


def _voted(name: str, assigned: str, centroids: str) -> str:
    word = lambda w: " + ".join(f"CASE WHEN sum(({w} >> {k}) & 1) > count(*) // 2 THEN {1 << k} ELSE 0 END" for k in range(32))
    return f"{name}v AS (SELECT c_id, CAST({word('w0')} AS BIGINT) AS w0, CAST({word('w1')} AS BIGINT) AS w1, count(*) AS n FROM {assigned} GROUP BY c_id), {name} AS (SELECT c.c_id, coalesce(v.w0, 0) AS w0, coalesce(v.w1, 0) AS w1, coalesce(v.n, 0) AS n FROM {centroids} c LEFT JOIN {name}v v USING (c_id))"


def _centres(df: DataFrame) -> DataFrame:
    return df.where("vec_id < 8").select(F.col("vec_id").alias("c_id"), "w0", "w1")


@query("A7 A8 A9 P7 K3", f"WITH {_D}, {_C0}, {_assigned('a0', 'c0')}, {_voted('c1', 'a0', 'c0')}, {_assigned('a1', 'c1')} SELECT c1.c_id, c1.w0, c1.w1, c1.n, count(a1.vec_id) AS n_after, CAST(coalesce(sum(a1.d), 0) AS BIGINT) AS sum_d FROM c1 LEFT JOIN a1 USING (c_id) GROUP BY ALL")
def kbm_one_round(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    first = _centres(df)
    new = cluster.update(cluster.assign(df.select("vec_id", "w0", "w1"), first), first)
    after = cluster.assign(df.select("vec_id", "w0", "w1"), new).groupBy("c_id").agg(F.count("*").alias("n_after"), F.sum("d").alias("sum_d"))
    return new.join(after, "c_id", "left").select("c_id", "w0", "w1", "n", F.coalesce("n_after", F.lit(0)).alias("n_after"), F.coalesce("sum_d", F.lit(0)).alias("sum_d"))


@query("K1 K2 K4 K5 K6 K7 W6")
def kbm_cluster(spark, sf_dir):
    centroids, _, _ = cluster.binary_means(descriptors(spark, sf_dir).select("vec_id", "w0", "w1"), k=8)
    return centroids


@query("K8")
def kbm_sweep(spark, sf_dir):
    """Rounds, seconds, last cost and sizes by number of clusters, each clustered to its end: the driver's loop is over parameters only.

    sizes: the rows that the last assignment gives each centroid, by its number. An empty table has no cost and no rows.
    """
    df = descriptors(spark, sf_dir).select("vec_id", "w0", "w1")
    out = None
    for k in (4, 8):
        began = time.monotonic()
        centroids, assigned, costs = cluster.binary_means(df, k=k)
        seconds = time.monotonic() - began
        n = centroids.select("c_id").join(assigned.groupBy("c_id").agg(F.count("*").alias("rows")), "c_id", "left")
        sizes = F.transform(F.array_sort(F.collect_list(F.struct("c_id", F.coalesce("rows", F.lit(0)).alias("rows")))), lambda x: x.rows)
        one = n.agg(F.lit(k).alias("k"), F.lit(len(costs) - 1).alias("rounds"), F.lit(seconds).alias("seconds"), F.lit(costs[-1]).cast("double").alias("cost"), sizes.alias("sizes"))
        out = one if out is None else out.unionByName(one)
    return out


@query("A22", f"WITH {_D}, {_C0}, {_assigned('a', 'c0')}, t AS (SELECT q.c_id, q.vec_id, sum({_APART}) AS cost FROM a q JOIN a m ON q.c_id = m.c_id GROUP BY ALL) SELECT c_id, vec_id AS medoid, CAST(cost AS BIGINT) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY c_id ORDER BY cost, vec_id) r FROM t) WHERE r = 1")
def kmedoid_round(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    return cluster.medoid_swap(df, _centres(df)).select("c_id", "medoid", "cost")


_NEAR = f"qc AS (SELECT q_id, c_id, d FROM (SELECT q.vec_id AS q_id, m.c_id, {_APART} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_APART}, m.c_id) AS r FROM d q JOIN c0 m ON true WHERE q.vec_id % 100 = 0) WHERE r <= {PROBES})"
_PRUNED = f"p AS (SELECT q.vec_id AS q_id, m.vec_id AS m_id, {_APART} AS d FROM qc JOIN d q ON q.vec_id = qc.q_id JOIN a m ON m.c_id = qc.c_id AND q.vec_id <> m.vec_id) {_TIES.format('p')}"


@query("J16", f"WITH {_D}, {_C0}, {_assigned('a', 'c0')}, {_NEAR}, {_PRUNED}")
def cluster_pruned_nn(spark, sf_dir):
    """The signs of these tables have no clusters, so that 0.9 of the neighbours are in the seven nearest of eight."""
    df = descriptors(spark, sf_dir)
    return cluster.pruned_nearest(asked(df), df, _centres(df), probes=PROBES)


FEW = search.LshParams(tables=3, bits=4, seed=5)
_FEW = (
    f"{_buckets(FEW)}, {_buckets(FEW, 'cb').replace('FROM d', 'FROM (SELECT c_id AS vec_id, w0, w1 FROM c0)')}, hc AS (SELECT DISTINCT q.vec_id AS q_id, m.vec_id AS c_id, {_APART} AS d FROM b q JOIN cb m ON q.tab = m.tab AND q.hash = m.hash WHERE q.vec_id % 100 = 0), "
    f"hq AS (SELECT q_id, c_id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, c_id) AS r FROM hc) WHERE r <= {PROBES}), nc AS (SELECT q_id, c_id, d FROM (SELECT q.vec_id AS q_id, m.c_id, {_APART} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_APART}, m.c_id) AS r FROM d q JOIN c0 m ON true WHERE q.vec_id % 100 = 0) WHERE r <= {PROBES}), "
    "qc AS (SELECT q_id, c_id FROM hq UNION ALL SELECT q_id, c_id FROM nc WHERE q_id NOT IN (SELECT q_id FROM hq))"
)


@query("J17", f"WITH {_D}, {_C0}, {_assigned('a', 'c0')}, {_FEW}, {_PRUNED}")
def cluster_pruned_lsh(spark, sf_dir):
    """Centroids by hashing. It looks into fewer clusters than cluster_pruned_nn, and so finds fewer of the neighbours."""
    df = descriptors(spark, sf_dir)
    centres = _centres(df)
    return cluster.pruned_nearest(asked(df), df, centres, chosen=cluster.hashed_centroids(asked(df), centres, FEW, PROBES))


# ---------------------------------------------------------------- retrieval

_WORDS = f"{_D}, {_C0}, {_assigned('a', 'c0')}, vw AS (SELECT a.vec_id, d.label AS image_id, a.c_id AS word FROM a JOIN d USING (vec_id))"


@query("J18 J19 J20", f"WITH {_D}, {_C0}, p AS (SELECT m.vec_id, q.c_id AS word, {_APART} AS d FROM d m JOIN c0 q ON true) SELECT vec_id, word, d FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY d) r FROM p) WHERE r = 1")
def visual_words(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    return retrieval.visual_words(df, _centres(df), all_ties=True)


@query(
    "J21 J25 P11 W3",
    f"WITH {_WORDS}, area AS (SELECT label AS image_id FROM embeddings GROUP BY label HAVING sqrt(avg(embedding[1]::DOUBLE) ** 2 + avg(embedding[2]::DOUBLE) ** 2) <= 0.05), post AS (SELECT word, image_id, count(*) AS tf FROM vw WHERE vec_id % 100 <> 0 GROUP BY ALL), idf AS (SELECT word, ln((SELECT count(DISTINCT image_id) FROM post) / count(*) + 1) AS idf FROM post GROUP BY word), "
    "w AS (SELECT image_id, word, tf * idf AS w FROM post JOIN idf USING (word)), n AS (SELECT image_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY image_id), q AS (SELECT word, count(*) * any_value(idf) AS qw FROM vw JOIN idf USING (word) WHERE vec_id % 100 = 0 GROUP BY word), "
    "s AS (SELECT image_id, sum(w * qw) / any_value(norm) AS score FROM w JOIN q USING (word) JOIN n USING (image_id) WHERE image_id IN (SELECT image_id FROM area) GROUP BY image_id) SELECT image_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, image_id LIMIT 5",
)
def image_scores_topk(spark, sf_dir):
    df = descriptors(spark, sf_dir)
    words = retrieval.visual_words(df, _centres(df)).join(df.select("vec_id", F.col("label").alias("image_id")), "vec_id")
    index = retrieval.postings(words.where("vec_id % 100 != 0"))
    q = words.where("vec_id % 100 = 0").groupBy("word").agg(F.count("*").alias("tf"))
    at = lambda k: F.col("embedding")[k].cast("double")
    features = table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), at(0).alias("x"), at(1).alias("y"))
    allowed = retrieval.in_area(features, "image_id", "x", "y", (0.0, 0.0), 0.05).where("inside")
    return retrieval.best_images(retrieval.scores(q, index), 5, allowed).select("image_id", F.round("score", 6).alias("score"))
