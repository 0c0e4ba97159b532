"""Streams give what their twins over tables give."""

import datetime

import pytest
from pyspark.sql import functions as F

from bitloom.streaming import frames as fr

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    path = str(tmp_path_factory.mktemp("events"))
    for part in range(3):
        rows = [(k, start + datetime.timedelta(minutes=7 * k), k % 3, rng.choice(["click", "error", "view"]), rng.uniform(0, 40)) for k in range(part * 100, part * 100 + 100)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return path


def test_tracking(spark, folder, tmp_path):
    # one file a batch, oldest first: state is carried from batch to batch
    frames = fr.as_frames(spark.read.parquet(f"{folder}/events.parquet"))
    stream = fr.finished(fr.tracked_stream(fr.event_stream(spark, folder, per_batch=10)), str(tmp_path / "out"))
    table = fr.tracked_table(frames)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, table.collect())) and table.count() == 300
    motion = {(r.key, r.seq): r.motion for r in fr.motion_table(frames).collect()}
    assert all(motion[r.key, r.seq] == pytest.approx(r.motion, abs=1e-12) for r in table.collect())


def test_repeats_within_the_watermark_go(spark, folder, tmp_path):
    twice = fr.event_stream(spark, folder, 10)
    out = fr.finished(fr.distinct_frames(twice.unionByName(fr.event_stream(spark, folder, 10))).select("key", "seq"), str(tmp_path / "out"))
    assert out.count() == out.distinct().count() == 300


def test_windows_close(spark, folder, tmp_path):
    out = fr.finished(fr.windows(fr.event_stream(spark, folder, 10), "6 hours"), str(tmp_path / "out"))
    frames = fr.as_frames(spark.read.parquet(f"{folder}/events.parquet"))
    want = {(r.start, r.quality): r.n for r in frames.groupBy(F.window("ts", "6 hours").start.alias("start"), "quality").agg(F.count("*").alias("n")).collect()}
    got = {(r.start, r.quality): r.n for r in out.collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_one_slot_holds_the_latest(spark, folder, tmp_path):
    out = fr.latest_slot(fr.event_stream(spark, folder, per_batch=1), str(tmp_path / "out"))
    assert out.count() == 3 and out.agg(F.max("seq")).first()[0] == 299


def test_lost_counts_and_key_frames():
    t = fr.Tracker()
    assert [t.step(k, "BAD", 0.0)[1] for k in range(7)] == [1, 2, 3, 4, 5, 6, 7] and t.step(7, "BAD", 0)[2]
    assert t.step(8, "GOOD", 0.0)[1:] == (0, False, True)
    assert not t.step(20, "GOOD", 50.0)[3] and not t.step(40, "GOOD", 5.0)[3] and t.step(41, "GOOD", 50.0)[3]
