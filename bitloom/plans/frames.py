"""Queries on frame streams: events by user."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bitloom.operators.lineage import shared_dir
from bitloom.plans.registry import query, table
from bitloom.sources.config import RunConfig
from bitloom.streaming import frames as fr

_F = "fr AS (SELECT user_id AS key, event_id AS seq, ts, CASE WHEN event_type = 'error' THEN 'BAD' WHEN event_type IN ('click', 'purchase') THEN 'GOOD' ELSE 'DODGY' END AS quality, value FROM events)"
_RUNS = "r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY key ORDER BY seq) - 1 AS BIGINT) AS run FROM (SELECT *, CASE WHEN quality IS NOT DISTINCT FROM lag(quality) OVER (PARTITION BY key ORDER BY seq) THEN 0 ELSE 1 END AS n FROM fr))"


def _frames(spark, sf_dir):
    return fr.as_frames(table(spark, sf_dir, "events"))


@query("S4 S5 S6 W8", f"WITH {_F}, {_RUNS} SELECT key, run, min(seq) AS first_seq, count(*) AS n FROM r GROUP BY ALL")
def history_runs(spark, sf_dir):
    return fr.runs(_frames(spark, sf_dir)).groupBy("key", "run").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))


@query("T5 A12", f"WITH {_F}, {_RUNS} SELECT key, min(seq) AS first_seq, count(*) AS n FROM r WHERE quality = 'BAD' GROUP BY key, run HAVING count(*) >= 2")
def lost_runs(spark, sf_dir):
    return fr.lost_runs(_frames(spark, sf_dir), 2)


@query("P13 T2", f"WITH {_F} SELECT key, seq, quality FROM (SELECT *, row_number() OVER w AS n, lag(quality) OVER w AS before FROM fr WINDOW w AS (PARTITION BY key ORDER BY seq)) WHERE n = 1 OR quality <> before")
def frame_dedup(spark, sf_dir):
    return fr.without_repeats(_frames(spark, sf_dir)).select("key", "seq", "quality")


@query("P12", f"WITH {_F} SELECT key, seq, quality FROM fr WHERE seq % 7 = 0")
def frame_skip(spark, sf_dir):
    return fr.every(_frames(spark, sf_dir), 7).select("key", "seq", "quality")


@query("P1 W9 S16", f"WITH {_F} SELECT key, seq, quality, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM fr) WHERE n = 1")
def latest_observation(spark, sf_dir):
    return fr.latest(_frames(spark, sf_dir)).select("key", "seq", "quality", "value")


@query("T4", f"WITH {_F}, w AS (SELECT key, seq, list(value) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM fr) SELECT key, seq, list_reduce(list_prepend(0.0::DOUBLE, v), lambda s, x: 0.9::DOUBLE * (0.5::DOUBLE * x + 0.5::DOUBLE * s)) AS motion FROM w")
def motion_ema(spark, sf_dir):
    return fr.motion_table(_frames(spark, sf_dir)).select("key", "seq", "motion")


@query("T8", f"WITH {_F}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM fr), g AS (SELECT *, sum(CASE WHEN quality = 'GOOD' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY n) AS good FROM n WHERE n > 10) SELECT key, min(seq) AS seq FROM g WHERE n > 35 AND good > 10 GROUP BY key")
def map_start(spark, sf_dir):
    return fr.first_initialised(_frames(spark, sf_dir))


@query("T12", f"WITH {_F}, k AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, quality = 'GOOD' AS kf FROM fr), l AS (SELECT *, max(CASE WHEN kf THEN n END) OVER (PARTITION BY key ORDER BY n) AS last FROM k) SELECT key, seq FROM l WHERE n - last = 9")
def nine_after_key_frame(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("key").orderBy("seq")
    f = _frames(spark, sf_dir).withColumn("n", F.row_number().over(w))
    return f.withColumn("last", F.max(F.when(F.col("quality") == "GOOD", F.col("n"))).over(w)).where("n - last = 9").select("key", "seq")


@query("T6")
def keyframe_policy(spark, sf_dir):
    return fr.tracked_table(_frames(spark, sf_dir)).where("key_frame").select("key", "seq", "motion", "lost")


@query("S15 T1 T4 T5 T6")
def stream_tracking(spark, sf_dir):
    return fr.finished(fr.tracked_stream(fr.event_stream(spark, sf_dir)), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


@query("T3", f"WITH {_F}, {_RUNS}, n AS (SELECT key, seq, row_number() OVER (PARTITION BY key, run ORDER BY seq) - 1 AS again FROM r), e AS (SELECT key, min(seq) AS stop FROM n WHERE again >= 3 AND seq > 100 OR seq > 9000 GROUP BY key) SELECT n.key, n.seq FROM n LEFT JOIN e ON n.key = e.key WHERE stop IS NULL OR seq < stop")
def stream_end(spark, sf_dir):
    return fr.until_end(_frames(spark, sf_dir), repeats=3, least=100, last=RunConfig(last_frame=9000).last_frame).select("key", "seq")


@query("T7", f"WITH {_F}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS n FROM fr) SELECT key, seq, n >= 20 AND n % 20 = 0 AS forced, n >= 20 AND n % 20 < 5 AS lost FROM n")
def forced_relocalisation(spark, sf_dir):
    return fr.forced_losses(_frames(spark, sf_dir), RunConfig(force_every=20).force_every, 5).select("key", "seq", "forced", "lost")


@query("T2", "SELECT user_id AS key, event_id AS seq FROM events")
def stream_dedup(spark, sf_dir):
    return fr.finished(fr.distinct_frames(fr.event_stream(spark, sf_dir)).select("key", "seq"), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


@query("T1")
def stream_windows(spark, sf_dir):
    """An addition: closed one-day windows by event time."""
    return fr.finished(fr.windows(fr.event_stream(spark, sf_dir)), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


@query("S16", "SELECT 0::BIGINT AS batch, max(event_id) AS seq FROM events")
def stream_latest_slot(spark, sf_dir):
    return fr.latest_slot(fr.event_stream(spark, sf_dir), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").select("batch", "seq")
