"""Queries on frames, points and measurements (orders, parts, line items), positions (customers) and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import geometry, robust
from bitloom.operators import graph, retrieval, spatial, stats
from bitloom.plans.registry import query, table

# ---------------------------------------------------------------- frames and points


def _frames(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("frame"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("fixed"), (F.floor("o_totalprice") % 1000).cast("double").alias("x"), (F.col("o_custkey") % 1000).cast("double").alias("y"))


def _edges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("point")).distinct()


_FRAMES = "f AS (SELECT o_orderkey AS frame, o_orderkey AS seq, o_orderstatus = 'F' AS fixed, (floor(o_totalprice) % 1000)::DOUBLE AS x, (o_custkey % 1000)::DOUBLE AS y FROM orders)"
_EDGES = "e AS (SELECT DISTINCT l_orderkey AS frame, l_partkey AS point FROM lineitem)"
_LOCAL = (
    f"{_FRAMES}, {_EDGES}, n AS (SELECT * FROM f ORDER BY seq DESC, frame DESC LIMIT 1), c AS (SELECT f.frame FROM f, n WHERE NOT f.fixed AND f.frame <> n.frame ORDER BY sqrt((f.x - n.x)**2 + (f.y - n.y)**2), f.frame LIMIT 4), "
    "a AS (SELECT frame FROM n UNION ALL SELECT frame FROM c), p AS (SELECT DISTINCT point FROM e WHERE frame IN (SELECT frame FROM a)), h AS (SELECT DISTINCT frame FROM e WHERE point IN (SELECT point FROM p) AND frame NOT IN (SELECT frame FROM a))"
)


@query("J27 J29 R22", f"WITH {_LOCAL} SELECT 'adjust' AS part, frame AS id FROM a UNION ALL SELECT 'point', point FROM p UNION ALL SELECT 'hold', frame FROM h")
def frame_bundle_local(spark, sf_dir):
    adjust, points, hold = graph.local_bundle(_frames(spark, sf_dir), _edges(spark, sf_dir))
    named = lambda df, part, c: df.select(F.lit(part).alias("part"), F.col(c).alias("id"))
    return named(adjust, "adjust", "frame").unionByName(named(points, "point", "point")).unionByName(named(hold, "hold", "frame"))


@query("J28", f"WITH {_FRAMES}, {_EDGES} SELECT 'adjust' AS part, count(*) AS n, sum(frame)::BIGINT AS ids FROM f WHERE NOT fixed UNION ALL SELECT 'point', count(DISTINCT point), sum(DISTINCT point)::BIGINT FROM e UNION ALL SELECT 'hold', count(*), sum(frame)::BIGINT FROM f WHERE fixed")
def frame_bundle_global(spark, sf_dir):
    adjust, points, hold = graph.global_bundle(_frames(spark, sf_dir), _edges(spark, sf_dir))
    named = lambda df, part, c: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.sum(c).alias("ids"))
    return named(adjust, "adjust", "frame").unionByName(named(points, "point", "point")).unionByName(named(hold, "hold", "frame"))


@query("J29", f"WITH {_LOCAL} SELECT e.frame, e.point FROM e WHERE frame IN (SELECT frame FROM a) AND point IN (SELECT point FROM p)")
def bundle_edges(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    adjust, points, _ = graph.local_bundle(_frames(spark, sf_dir), edges)
    return graph.restricted(edges, adjust, points)


@query("J29 W11", "SELECT l_partkey AS point, row_number() OVER (ORDER BY l_partkey) - 1 AS dense FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def dense_point_ids(spark, sf_dir):
    return graph.dense_ids(_edges(spark, sf_dir), "point", "dense")


@query("J36", "WITH x AS (SELECT o_orderkey AS frame FROM orders ORDER BY o_orderkey DESC LIMIT 1) SELECT x.frame, p.p_partkey AS point FROM x, part p WHERE (x.frame, p.p_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem) AND p.p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = x.frame)")
def edges_not_seen(spark, sf_dir):
    newest = _frames(spark, sf_dir).orderBy(F.desc("seq")).limit(1)
    never = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("point"))
    return graph.unseen(newest, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point")), _edges(spark, sf_dir), never)


@query("A19 R11", "SELECT l_partkey AS point, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) = sum(CASE WHEN l_discount >= 0.02 THEN 1 ELSE 0 END)")
def outlier_points(spark, sf_dir):
    return graph.outlier_points(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("point"), (F.col("l_discount") >= 0.02).alias("outlier")))


_COUNTS = "c AS (SELECT l_partkey AS point, count(*) FILTER (l_returnflag = 'R') AS n_out, count(*) FILTER (l_returnflag = 'A') AS n_in FROM lineitem GROUP BY l_partkey)"


def _point_counts(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("point")).agg(F.count_if(F.col("l_returnflag") == "R").alias("n_out"), F.count_if(F.col("l_returnflag") == "A").alias("n_in"))


@query("P8", f"WITH {_COUNTS} SELECT e.frame, e.point FROM (SELECT DISTINCT l_orderkey AS frame, l_partkey AS point FROM lineitem) e WHERE point NOT IN (SELECT point FROM c WHERE n_out > 8 AND n_out > n_in)")
def edges_without_bad_points(spark, sf_dir):
    return graph.without_points(_edges(spark, sf_dir), graph.bad_points(_point_counts(spark, sf_dir), 8))


@query("P9", f"WITH {_COUNTS} SELECT point, n_out, n_in, n_out > 8 AND n_out > n_in AS trash FROM c")
def points_to_trash(spark, sf_dir):
    return graph.split_bad(_point_counts(spark, sf_dir), 8)


@query("P4 J36", "WITH x AS (SELECT o_orderkey AS frame FROM orders ORDER BY o_orderkey DESC LIMIT 10), e AS (SELECT x.frame, p.p_partkey AS point, (p_size % 7 - 3) / 4.0::DOUBLE AS x, (p_partkey % 11 - 5) / 8.0::DOUBLE AS y, (p_partkey % 5 - 1) / 1.0::DOUBLE AS z FROM x, part p WHERE (x.frame, p.p_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem)), q AS (SELECT *, CASE WHEN z < 0.001 THEN NULL WHEN sqrt(x*x/(z*z) + y*y/(z*z)) < 0.001 THEN 1.0 ELSE atan(sqrt(x*x/(z*z) + y*y/(z*z)) * 2 * tan(0.05)) / (sqrt(x*x/(z*z) + y*y/(z*z)) * 0.1) END AS k FROM e) SELECT frame, point, NOT coalesce(z >= 0.001 AND x / z * k * 320 + 319.5 BETWEEN 0 AND 639 AND y / z * k * 360 + 239.5 BETWEEN 0 AND 479, false) AS never FROM q")
def refind_failures(spark, sf_dir):
    """The ten newest frames against all points that they haven't: which of them can't be seen and are never to be tried again."""
    newest = _frames(spark, sf_dir).orderBy(F.desc("seq")).limit(10)
    k = F.col("point")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point"), ((F.col("p_size") % 7 - 3) / 4.0).alias("x"))
    pairs = graph.unseen(newest, p, _edges(spark, sf_dir)).join(p, "point")
    camera = geometry.FieldOfViewCamera()
    return graph.refind(pairs, camera.visible(F.col("x"), (k % 11 - 5) / 8.0, (k % 5 - 1) / F.lit(1.0)))


@query("R22", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0::DOUBLE ELSE p_size / 2.0::DOUBLE END AS x, CASE WHEN p_size % 3 > 0 THEN round(sqrt(1 / (p_size % 3)::DOUBLE), 9) END AS noise FROM part")
def bundle_inserts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_size") / 2).alias("x"), (F.col("p_size") % 3).cast("double").alias("sigma2"))
    return graph.with_noise(graph.clean_nan(p, ("x",))).select("p_partkey", "x", F.round("noise", 9).alias("noise"))


_ROWS = "m AS (SELECT l_orderkey % 100 AS camera, l_partkey AS point, l_linenumber::DOUBLE AS a0, (l_quantity % 7)::DOUBLE AS a1, (l_suppkey % 5)::DOUBLE AS b0, (l_orderkey % 3)::DOUBLE AS b1, (l_partkey % 11)::DOUBLE AS e0, (l_quantity % 4)::DOUBLE AS e1, CASE WHEN l_returnflag = 'R' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM lineitem)"
_BLOCKS = {"camera": "camera AS id, 'camera' AS block, sum(w * (a0 * a0 + b0 * b0)) AS s_0_0, sum(w * (a0 * a1 + b0 * b1)) AS s_0_1, sum(w * (a1 * a0 + b1 * b0)) AS s_1_0, sum(w * (a1 * a1 + b1 * b1)) AS s_1_1", "point": "point AS id, 'point' AS block, sum(w * (a0 * e0 + b0 * e1)) AS s_0_0, sum(w * (a0 * e1 + b0 * e0)) AS s_0_1, sum(w * (a1 * e0 + b1 * e1)) AS s_1_0, sum(w * (a1 * e1 + b1 * e0)) AS s_1_1"}


@query("A18 A15", f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT {columns} FROM m GROUP BY {by}" for by, columns in _BLOCKS.items()))
def bundle_blocks(spark, sf_dir):
    """Weighted sums of products of two residuals' derivatives: by camera with themselves, by point with the residuals."""
    li = table(spark, sf_dir, "lineitem")
    number = lambda c: c.cast("double")
    a = [number(F.col("l_linenumber")), number(F.col("l_quantity") % 7)]
    b = [number(F.col("l_suppkey") % 5), number(F.col("l_orderkey") % 3)]
    e = [number(F.col("l_partkey") % 11), number(F.col("l_quantity") % 4)]
    w = F.when(F.col("l_returnflag") == "R", 0.5).otherwise(1.0)
    rows = li.withColumns({"camera": F.col("l_orderkey") % 100, "point": F.col("l_partkey")})
    cameras = stats.block_sums(rows, ["camera"], [a, b], [a, b], w).select(F.col("camera").alias("id"), F.lit("camera").alias("block"), *[f"s_{i}_{j}" for i in (0, 1) for j in (0, 1)])
    points = stats.block_sums(rows, ["point"], [a, b], [e, e[::-1]], w).select(F.col("point").alias("id"), F.lit("point").alias("block"), *[f"s_{i}_{j}" for i in (0, 1) for j in (0, 1)])
    return cameras.unionByName(points)


@query("J37", "SELECT DISTINCT l_orderkey AS frame, l_partkey AS point FROM lineitem f WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = f.l_orderkey AND s.l_partkey = f.l_partkey AND s.l_returnflag <> 'N')")
def retry_queue(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("point"), "l_returnflag")
    return graph.retry_queue(e.where("l_returnflag = 'N'"), e.where("l_returnflag != 'N'"))


@query("A18", f"WITH {_EDGES} SELECT a.frame AS j, b.frame AS k, count(*) AS n FROM e a JOIN e b ON a.point = b.point AND a.frame < b.frame GROUP BY ALL")
def covisible_frames(spark, sf_dir):
    return graph.covisible(_edges(spark, sf_dir)).groupBy("j", "k").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- positions


def _places(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.floor(F.col("c_acctbal")) % 1000).cast("double").alias("x"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("y"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") * 7 % 360).cast("double").alias("angle"), F.col("c_mktsegment").alias("segment"))


_PLACES = "pl AS (SELECT c_custkey AS id, (floor(c_acctbal) % 1000)::DOUBLE AS x, (c_custkey * 37 % 1000)::DOUBLE AS y, c_nationkey AS nation, (c_custkey * 7 % 360)::DOUBLE AS angle, c_mktsegment AS segment FROM customer)"
_APART = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query("J26 W4 F8", f"WITH {_PLACES}, p AS (SELECT a.id, b.id AS other, {_APART} AS d FROM pl a JOIN pl b ON a.id <> b.id WHERE a.id % 100 = 0) SELECT id, other, round(d, 6) AS d, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM p) WHERE r <= 4")
def nearest_frames(spark, sf_dir):
    pl = _places(spark, sf_dir)
    return spatial.nearest(pl.where("id % 100 = 0"), pl, 4, "id").select("id", "other", F.round("d", 6).alias("d"), "rank")


@query("J22", f"WITH {_PLACES} SELECT a.id FROM pl a WHERE a.nation <> 0 AND EXISTS (SELECT 1 FROM pl b WHERE b.nation = 0 AND {_APART} <= 15)")
def radius_semi(spark, sf_dir):
    pl = _places(spark, sf_dir)
    return spatial.near_semi(pl.where("nation != 0"), pl.where("nation = 0"), 15.0, "id", "id").select("id")


@query("J30", f"WITH {_PLACES} SELECT a.id FROM pl a WHERE a.nation <> 0 AND NOT EXISTS (SELECT 1 FROM pl b WHERE b.nation = 0 AND {_APART} <= 15)")
def radius_anti(spark, sf_dir):
    pl = _places(spark, sf_dir)
    return spatial.near_anti(pl.where("nation != 0"), pl.where("nation = 0"), 15.0, "id", "id").select("id")


@query("J31", f"WITH {_PLACES} SELECT a.id AS l_id, b.id AS r_id, round({_APART}, 6) AS d FROM pl a JOIN pl b ON a.segment = 'BUILDING' AND b.segment <> 'BUILDING' AND {_APART} <= 10")
def radius_join(spark, sf_dir):
    pl = _places(spark, sf_dir)
    return spatial.within(pl.where("segment = 'BUILDING'"), pl.where("segment != 'BUILDING'"), 10.0, "id", "id").select("l_id", "r_id", F.round("d", 6).alias("d"))


@query("J23 F7", f"WITH {_PLACES}, m AS (SELECT nation, avg(x) AS mx, avg(y) AS my FROM pl GROUP BY nation) SELECT nation, round(sqrt((mx - 500)**2 + (my - 500)**2), 6) AS d, sqrt((mx - 500)**2 + (my - 500)**2) <= 50 AS inside FROM m")
def area_mean_flag(spark, sf_dir):
    return retrieval.in_area(_places(spark, sf_dir), "nation", "x", "y", (500.0, 500.0), 50.0).select("nation", F.round("d", 6).alias("d"), "inside")


@query("J24 J25 F7", f"WITH {_PLACES} SELECT a.id AS l_id, b.id AS r_id FROM pl a JOIN pl b ON {_APART} <= 20 AND CASE WHEN abs(a.angle - b.angle) % 360 > 180 THEN 360 - abs(a.angle - b.angle) % 360 ELSE abs(a.angle - b.angle) % 360 END <= 15 WHERE a.id % 100 = 0")
def angle_window_join(spark, sf_dir):
    pl = _places(spark, sf_dir)
    return retrieval.surrounding(pl, pl.where("id % 100 = 0"), 20.0, 15.0, "id").select("l_id", "r_id")


@query("J39", f"WITH {_PLACES}, p AS (SELECT a.id, b.id AS other, {_APART} AS d FROM pl a JOIN pl b ON a.id <> b.id AND {_APART} BETWEEN 10 AND 60 WHERE (b.x - a.x) / {_APART} >= cos(radians(10))) SELECT id, other, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) r FROM p) WHERE r = 1")
def cone_nearest(spark, sf_dir):
    pl = _places(spark, sf_dir).select("id", "x", "y")
    return spatial.in_cone(pl, pl, "id", 10.0, 60.0, 10.0, (1.0, 0.0)).select("id", "other", F.round("d", 6).alias("d"))


@query("J40", "WITH g AS (SELECT c_custkey AS id, c_custkey % 40 AS gx, c_custkey // 40 AS gy FROM customer) SELECT a.id, b.id AS neighbour FROM g a JOIN g b ON abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1")
def grid_links(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).alias("gx"), F.floor(F.col("c_custkey") / 40).alias("gy"))
    return spatial.grid_links(c, "id")


@query("W13", "WITH g AS (SELECT c_custkey AS id, c_custkey % 40 AS gx, c_custkey // 40 AS gy FROM customer WHERE c_mktsegment <> 'BUILDING'), n AS (SELECT a.id, count(b.id) AS held FROM g a LEFT JOIN g b ON abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1 GROUP BY a.id) SELECT id, CASE held WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 10 WHEN 3 THEN 20 ELSE 100 END AS potential FROM n ORDER BY potential DESC, id LIMIT 1")
def next_to_expand(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment != 'BUILDING'").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).alias("gx"), F.floor(F.col("c_custkey") / 40).alias("gy"))
    held = spatial.grid_links(c, "id").groupBy("id").count()
    n = F.coalesce(F.col("count"), F.lit(0))
    potential = F.when(n == 0, 0).when(n == 1, 1).when(n == 2, 10).when(n == 3, 20).otherwise(100)
    return c.join(held, "id", "left").select("id", potential.alias("potential")).orderBy(F.desc("potential"), "id").limit(1)


@query("P2 P3 P4 F10 F12", "WITH p AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 20 AS x, (l_discount - 0.05) * 20 AS y, l_tax * 50 AS z FROM lineitem), q AS (SELECT *, CASE WHEN sqrt(x*x/(z*z) + y*y/(z*z)) < 0.001 THEN 1.0 ELSE atan(sqrt(x*x/(z*z) + y*y/(z*z)) * 2 * tan(0.05)) / (sqrt(x*x/(z*z) + y*y/(z*z)) * 0.1) END AS k FROM p WHERE z >= 0.001) SELECT l_orderkey, l_linenumber, round(x / z * k * 320 + 319.5, 4) AS u, round(y / z * k * 360 + 239.5, 4) AS v FROM q WHERE x / z * k * 320 + 319.5 BETWEEN 0 AND 639 AND y / z * k * 360 + 239.5 BETWEEN 0 AND 479")
def visible_points(spark, sf_dir):
    camera = geometry.FieldOfViewCamera()
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") - 25) / 20).alias("x"), ((F.col("l_discount") - 0.05) * 20).alias("y"), (F.col("l_tax") * 50).alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    u, v, _ = camera.project(x / z, y / z)
    return p.where(camera.visible(x, y, z)).select("l_orderkey", "l_linenumber", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


@query("F11 F13 F14 F15 F16 F17 P5 F28", "WITH p AS (SELECT p_partkey, (p_size % 7 + 1) / 10.0::DOUBLE AS x, (p_partkey % 11 - 5) / 10.0::DOUBLE AS y, p_size % 4 AS l FROM part) SELECT p_partkey, round(x * 300 + 320, 6) AS pin_u, round((x + 0.5) * 2**l - 0.5, 6) AS root_x, round(x * y - l * 2, 6) AS det, CASE WHEN x * 10 <= 3 THEN CASE WHEN x * 10 >= 0.25 THEN 0 END WHEN x * 2.5 <= 3 THEN 1 END AS level, CAST((p_size + p_partkey % 256 + 100) // 3 AS INTEGER) AS gray FROM p JOIN part USING (p_partkey)")
def geometry_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", ((F.col("p_size") % 7 + 1) / 10.0).alias("x"), ((F.col("p_partkey") % 11 - 5) / 10.0).alias("y"), (F.col("p_size") % 4).alias("l"))
    x, y, level = F.col("x"), F.col("y"), F.col("l")
    return p.select(
        "p_partkey",
        F.round(geometry.PinholeCamera().project(x, y)[0], 6).alias("pin_u"),
        F.round(geometry.to_root(x, level), 6).alias("root_x"),
        F.round(geometry.det2(x, F.lit(2.0), level, y), 6).alias("det"),
        geometry.search_level(x * 10).alias("level"),
        geometry.gray(F.col("p_size"), F.col("p_partkey") % 256, F.lit(100)).alias("gray"),
    )


@query("R15", "SELECT s_suppkey, round(2.0::DOUBLE * -s_nationkey + 1, 6) AS x, round(2.0::DOUBLE * s_suppkey + 2, 6) AS y, round(2.0 * floor(s_acctbal) + 3, 6) AS z FROM supplier")
def map_transform(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.floor("s_acctbal").cast("double").alias("z"))
    return graph.transformed(p, [[0, -1, 0], [1, 0, 0], [0, 0, 1]], [1.0, 2.0, 3.0], 2.0)


# ---------------------------------------------------------------- aggregates

_CENTRED = "r AS (SELECT l_returnflag AS g, (l_quantity - 25) * (l_quantity - 25) AS e2 FROM lineitem), s AS (SELECT g, count(*) AS n, list_sort(list(e2)) AS v FROM r GROUP BY g), m AS (SELECT g, n, v[n // 2 + 1] AS md FROM s), b AS (SELECT g, n, 1.4826 * (1 + 5.0::DOUBLE / (2 * n - 6)) * sqrt(md) AS sg FROM m)"


def _errors(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity") - 25
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("v"), (q * q).alias("e2"))


@query("A13", f"WITH {_CENTRED} SELECT g, n, round((4.6851 * sg)**2, 6) AS tukey, round((4.6851 * sg)**2, 6) AS cauchy, round((1.345 * sg)**2, 6) AS huber FROM b")
def robust_sigma(spark, sf_dir):
    return stats.robust_sigma(_errors(spark, sf_dir), ["g"], "e2").select("g", "n", *[F.round(c, 6).alias(c) for c in ("tukey", "cauchy", "huber")])


@query("A14 A16 F20", f"WITH {_CENTRED}, w AS (SELECT g, e2, (4.6851 * sg / 4)**2 AS s2 FROM r JOIN b USING (g)) SELECT g, round(sum(CASE WHEN e2 > s2 THEN 0 ELSE (1 - e2 / s2)**2 END), 4) AS w_tukey, round(sum(1 / (1 + e2 / s2)), 4) AS w_cauchy, round(sum(CASE WHEN e2 < s2 THEN 1 ELSE sqrt(s2 / e2) END), 4) AS w_huber, round(sum(CASE WHEN e2 > s2 THEN 1 ELSE 1 - (1 - e2 / s2)**3 END), 4) AS o_tukey, round(sum(ln(1 + e2 / s2)), 4) AS o_cauchy, round(avg(e2), 4) AS mean_square FROM w GROUP BY g")
def robust_weights(spark, sf_dir):
    rows = _errors(spark, sf_dir)
    s2 = stats.robust_sigma(rows, ["g"], "e2").select("g", (F.col("tukey") / 16).alias("s2"))
    w = rows.join(s2, "g")
    e2, s = F.col("e2"), F.col("s2")
    out = {"w_tukey": robust.weight("tukey", e2, s), "w_cauchy": robust.weight("cauchy", e2, s), "w_huber": robust.weight("huber", e2, s), "o_tukey": robust.objective("tukey", e2, s), "o_cauchy": robust.objective("cauchy", e2, s)}
    return w.groupBy("g").agg(*[F.round(F.sum(c), 4).alias(k) for k, c in out.items()], F.round(F.avg("e2"), 4).alias("mean_square"))


@query("A15 R17", "WITH m AS (SELECT l_returnflag AS g, avg(l_quantity) AS mu FROM lineitem GROUP BY g), e AS (SELECT l_returnflag AS g, l_quantity AS v, mu, (l_quantity - mu) * (l_quantity - mu) AS e2 FROM lineitem JOIN m ON m.g = l_returnflag), s AS (SELECT g, (4.6851 * 1.4826 * (1 + 5.0::DOUBLE / (2 * count(*) - 6)))**2 * list_sort(list(e2))[count(*) // 2 + 1] AS s2 FROM e GROUP BY g), w AS (SELECT g, v, mu, CASE WHEN e2 > s2 THEN 0 ELSE (1 - e2 / s2)**2 END AS w FROM e JOIN s USING (g)) SELECT g, round((sum(w * v) + 100 * any_value(mu)) / (sum(w) + 100), 6) AS location, round(sum(w), 4) AS weight FROM w GROUP BY g")
def robust_location(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("v"))
    return stats.robust_location(rows, ["g"], "v", "tukey", 100.0).select("g", F.round("location", 6).alias("location"), F.round("weight", 4).alias("weight"))


@query("A10 A11", "SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) > 3 THEN round(avg(l_quantity), 6) END AS depth_mean, CASE WHEN count(*) > 3 THEN round(sqrt(greatest(avg(l_quantity * l_quantity) - avg(l_quantity) * avg(l_quantity), 0)), 6) END AS depth_sigma FROM lineitem GROUP BY l_orderkey")
def depth_stats(spark, sf_dir):
    return stats.depth_stats(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", 3).select("l_orderkey", "n", F.round("depth_mean", 6).alias("depth_mean"), F.round("depth_sigma", 6).alias("depth_sigma"))


@query("A24", "SELECT l_returnflag, CAST(l_linenumber % 4 AS INTEGER) AS level, count(*) AS attempted, count(*) FILTER (l_quantity > 20) AS found FROM lineitem GROUP BY ALL")
def search_counters(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 4).cast("int").alias("level"), (F.col("l_quantity") > 20).alias("ok"))
    return stats.search_counters(li, ["l_returnflag"], "level", "ok")


@query("A12", "WITH a AS (SELECT user_id, count(*) AS attempted, count(*) FILTER (event_type IN ('click', 'purchase')) AS found, count(*) FILTER (event_id % 4 >= 2) AS ca, count(*) FILTER (event_id % 4 >= 2 AND event_type IN ('click', 'purchase')) AS cf, max(CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 ELSE 0 END) AS x FROM events GROUP BY user_id) SELECT user_id, attempted, found, CASE WHEN found / attempted > 0.3 THEN 'GOOD' WHEN (CASE WHEN ca > 10 THEN cf / ca ELSE found / attempted END) < 0.13 THEN 'BAD' WHEN x = 1 THEN 'BAD' ELSE 'DODGY' END AS quality FROM a")
def tracking_quality(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).alias("level"), F.col("event_type").isin("click", "purchase").alias("ok"), ((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)).alias("far"))
    return stats.tracking_quality(e, ["user_id"], "level", "ok", "far")


@query("A17 R12", "WITH p AS (SELECT l_returnflag AS g, l_quantity AS x, l_linenumber::DOUBLE AS y, (l_orderkey % 100)::DOUBLE AS z FROM lineitem) SELECT g, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz, round(sum(x*x) - sum(x)*sum(x)/count(*), 2) AS sxx, round(sum(x*y) - sum(x)*sum(y)/count(*), 2) AS sxy, round(sum(x*z) - sum(x)*sum(z)/count(*), 2) AS sxz, round(sum(y*y) - sum(y)*sum(y)/count(*), 2) AS syy, round(sum(y*z) - sum(y)*sum(z)/count(*), 2) AS syz, round(sum(z*z) - sum(z)*sum(z)/count(*), 2) AS szz FROM p GROUP BY g")
def plane_sums(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), (F.col("l_orderkey") % 100).cast("double").alias("z"))
    s = stats.plane_sums(p, ["g"])
    return s.select("g", "n", *[F.round(c, 6).alias(c) for c in ("mx", "my", "mz")], *[F.round(c, 2).alias(c) for c in ("sxx", "sxy", "sxz", "syy", "syz", "szz")])


@query("W12", "WITH v AS (SELECT p_brand AS g, p_retailprice AS x FROM part), s AS (SELECT g, list_sort(list(x)) AS l, count(*) AS n FROM v GROUP BY g) SELECT g, l[CAST(ceil(0.1 * n) AS BIGINT)] AS low, l[CAST(floor(0.9 * n) AS BIGINT) + 1] AS high FROM s WHERE n >= 10")
def percentile_thresholds(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_retailprice").alias("x"))
    return stats.at_ranks(p, ["g"], "x", low=F.ceil(F.col("n") * 0.1) - 1, high=F.floor(F.col("n") * 0.9)).where("n >= 10").select("g", "low", "high")


@query("W5 W7", "SELECT p_partkey, p_retailprice FROM part WHERE p_size >= 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def best_corners(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size >= 10").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100)


@query("W10", "SELECT p_partkey, CAST(level AS INTEGER) AS level FROM (SELECT p_partkey, p_size % 4 AS level, row_number() OVER (PARTITION BY p_size % 4 ORDER BY (p_partkey * 2654435761) % 4294967296, p_partkey) AS r FROM part) WHERE r <= 20")
def level_sample(spark, sf_dir):
    return graph.level_sample(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("level")), 20, "level", "p_partkey")


@query("J40", f"WITH {_PLACES}, p AS (SELECT a.id AS key, b.id AS id, sqrt((a.x + 20 - b.x)**2 + (a.y - b.y)**2) AS d FROM pl a JOIN pl b ON sqrt((a.x + 20 - b.x)**2 + (a.y - b.y)**2) < 12 WHERE a.id % 10 = 0) SELECT key, id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, id) AS r FROM p) WHERE r = 1")
def predicted_corners(spark, sf_dir):
    """The place nearest to one step to the right of every tenth, taken if nearer than 0.3 steps of 40."""
    pl = _places(spark, sf_dir)
    expected = pl.where("id % 10 = 0").select(F.col("id").alias("key"), (F.col("x") + 20).alias("x"), "y")
    return spatial.predicted_corner(expected, pl.select("id", "x", "y"), "id", 40.0).select("key", "id", F.round("d", 6).alias("d"))


@query("P6 P14", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS class_id FROM orders WHERE o_totalprice > 7000 AND o_orderpriority <> '5-LOW'")
def candidate_keypoints(spark, sf_dir):
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders").where("o_totalprice > 7000 and o_orderpriority != '5-LOW'")
    return o.select("o_orderkey", (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("class_id"))


_BAND = "g AS (SELECT s_suppkey AS segment, ((s_suppkey + 7) * 53 % 1000)::DOUBLE AS ax, ((s_suppkey + 7) * 17 % 1000)::DOUBLE AS ay, ((s_suppkey + 7) * 91 % 1000)::DOUBLE AS bx, ((s_suppkey + 7) * 29 % 1000)::DOUBLE AS by2 FROM supplier WHERE s_suppkey % 100 = 0), u AS (SELECT *, sqrt((bx - ax)**2 + (by2 - ay)**2) AS l FROM g), w AS (SELECT *, (bx - ax) / l AS ux, (by2 - ay) / l AS uy FROM u WHERE l > 0)"


@query("J31", f"WITH {_PLACES}, {_BAND} SELECT w.segment, pl.id AS point, round(abs((pl.y - ay) * ux - (pl.x - ax) * uy), 6) AS across FROM pl JOIN w ON abs((pl.y - ay) * ux - (pl.x - ax) * uy) <= 15 AND (pl.x - ax) * ux + (pl.y - ay) * uy BETWEEN -15 AND l + 15")
def epipolar_band(spark, sf_dir):
    k = F.col("s_suppkey")
    segments = table(spark, sf_dir, "supplier").where("s_suppkey % 100 = 0").select(k.alias("segment"), *[((k + 7) * m % 1000).cast("double").alias(c) for c, m in (("ax", 53), ("ay", 17), ("bx", 91), ("by", 29))])
    return spatial.in_band(segments, _places(spark, sf_dir), 15.0, "segment", "id").select("segment", "point", F.round("across", 6).alias("across"))
