"""Frame streams: repeats, the latest frame, and a tracker's state by key, as streams and over tables.

A frame is a row (key, seq, ts, quality, value). The tracker's state moves frame by frame in order of seq: a motion
average, a count of lost frames, and the choice of key frames. One step function serves the stream, where each key's
state lives in Spark's state store, and the table, where sorted partitions are walked row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME = "key long, seq long, ts timestamp, quality string, value double"
TRACKED = "key long, seq long, motion double, lost int, recovering boolean, key_frame boolean"
_STATE = "motion double, lost int, last_seq long, last_value double, taken int"


@dataclass
class Tracker:
    """A key's state. A frame is a key frame if it is good, far from the last one and enough frames after it."""

    motion: float = 0.0
    lost: int = 0
    last_seq: int = -1
    last_value: float = 0.0
    taken: int = 0

    def step(self, seq: int, quality: str | None, value: float, far: float = 10.0, gap: int = 20, patience: int = 6) -> tuple:
        self.motion = 0.9 * (0.5 * value + 0.5 * self.motion)
        self.lost = self.lost + 1 if quality == "BAD" else 0
        chosen = quality == "GOOD" and (self.last_seq < 0 or abs(value - self.last_value) > far and seq - self.last_seq > gap)
        if chosen:
            self.last_seq, self.last_value, self.taken = seq, value, self.taken + 1
        return self.motion, self.lost, self.lost >= patience, chosen


def tracked_table(frames: DataFrame) -> DataFrame:
    """TRACKED of a table of frames. Keys are dealt out and sorted; a task holds one key's state at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        key, state = None, Tracker()
        for batch in batches:
            rows = []
            for k, seq, quality, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if k != key:
                    key, state = k, Tracker()
                rows.append((k, seq, *state.step(seq, quality, value or 0.0)))
            cols = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "seq", "motion", "lost", "recovering", "key_frame"])

    return frames.select("key", "seq", "quality", "value").repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, TRACKED)


def tracked_stream(frames: DataFrame) -> DataFrame:
    """TRACKED of a stream; frames of a key are ordered within each micro-batch."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = Tracker(*held.get) if held.exists else Tracker()
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        out = [(key[0], r.seq, *state.step(int(r.seq), r.quality, float(r.value))) for r in rows.itertuples()]
        held.update(astuple(state))
        yield pd.DataFrame(out, columns=["key", "seq", "motion", "lost", "recovering", "key_frame"])

    return frames.groupBy("key").applyInPandasWithState(run, TRACKED, _STATE, "append", GroupStateTimeout.NoTimeout)


def motion_table(frames: DataFrame) -> DataFrame:
    """(key, seq, motion): the motion average over all of a key's frames, by the tracker's own steps."""
    return tracked_table(frames).select("key", "seq", "motion")


def until_end(frames: DataFrame, repeats: int = 2500, least: int = 100, last: int = -1, value: str = "quality") -> DataFrame:
    """Each key's frames before its end: the first frame behind `least` that repeats its value so many times on end, or the
    first behind `last`, if that is not negative."""
    w = W.partitionBy("key", "run").orderBy("seq")
    numbered = runs(frames, value).withColumn("_n", F.row_number().over(w) - 1)
    over = (F.col("_n") >= repeats) & (F.col("seq") > least)
    if last >= 0:
        over = over | (F.col("seq") > last)
    # a key's frames are in order already for its runs
    ended = F.max(over.cast("int")).over(W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return numbered.withColumn("_over", ended).where("_over = 0").drop("_over", "_n", "run")


def forced_losses(frames: DataFrame, every: int, length: int) -> DataFrame:
    """frames with forced, true on every so-many-th of a key's frames, where relocalisation is asked for, and lost, true on
    that and the next ones up to `length`, for which the tracker is held to be lost. every 0: never."""
    n = F.row_number().over(W.partitionBy("key").orderBy("seq")) - 1
    if every < 1:
        return frames.select("*", F.lit(False).alias("forced"), F.lit(False).alias("lost"))
    return frames.withColumn("_n", n).select(*frames.columns, ((F.col("_n") >= every) & (F.col("_n") % every == 0)).alias("forced"), ((F.col("_n") >= every) & (F.col("_n") % every < length)).alias("lost"))


def runs(frames: DataFrame, value: str = "quality") -> DataFrame:
    """frames with run: the number of the stretch of equal consecutive values, from 0, in each key."""
    w = W.partitionBy("key").orderBy("seq")
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return frames.withColumn("_new", new).withColumn("run", (F.sum("_new").over(w) - 1).cast("long")).drop("_new")


def without_repeats(frames: DataFrame, value: str = "quality") -> DataFrame:
    """Frames whose value differs from the one before."""
    w = W.partitionBy("key").orderBy("seq")
    first = F.row_number().over(w) == 1
    return frames.withColumn("_r", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("_r").drop("_r")


def lost_runs(frames: DataFrame, patience: int) -> DataFrame:
    """Stretches of BAD frames, patience or more of them: (key, first_seq, n)."""
    return runs(frames).where("quality = 'BAD'").groupBy("key", "run").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n")).where(F.col("n") >= patience).select("key", "first_seq", "n")


def latest(frames: DataFrame) -> DataFrame:
    """Each key's last frame, by seq."""
    return frames.groupBy("key").agg(F.max_by(F.struct("seq", "ts", "quality", "value"), "seq").alias("l")).select("key", "l.*")


def every(frames: DataFrame, n: int) -> DataFrame:
    """One frame of n, by seq."""
    return frames.where(F.col("seq") % n == 0)


def first_initialised(frames: DataFrame, start: int = 10, least: int = 25, trails: int = 10) -> DataFrame:
    """(key, seq): the frame at which each key's map is started: the first later than start + least with over `trails` good frames since start."""
    w = W.partitionBy("key").orderBy("n")
    numbered = frames.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("seq"))).where(F.col("n") > start)
    good = F.sum((F.col("quality") == "GOOD").cast("int")).over(w)
    return numbered.withColumn("good", good).where((F.col("n") > start + least) & (F.col("good") > trails)).groupBy("key").agg(F.min("seq").alias("seq"))


# ---------------------------------------------------------------- streams


def event_stream(spark: SparkSession, sf_dir: str, per_batch: int = 1) -> DataFrame:
    """The events table as a stream of frames; its timestamps get a zone, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return as_frames(raw)


def as_frames(events: DataFrame) -> DataFrame:
    quality = F.when(F.col("event_type") == "error", "BAD").when(F.col("event_type").isin("click", "purchase"), "GOOD").otherwise("DODGY")
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), quality.alias("quality"), "value")


def distinct_frames(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """Frames without repeats of a (key, seq) that came within the watermark."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(["key", "seq"])


def windows(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Closed event-time windows by quality: counts and sums."""
    w = F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w, "quality").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "quality", "n", "value")


def finished(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what there is, into a table at path with its checkpoint beside it, and reads it."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}.state").option("path", path).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def latest_slot(stream: DataFrame, path: str) -> DataFrame:
    """The newest frame of each micro-batch, older unread ones dropped, as a consumer with one slot would see them."""

    def take(batch: DataFrame, number: int) -> None:
        batch.agg(F.max_by(F.struct("key", "seq", "ts", "quality", "value"), "seq").alias("l")).where("l is not null").select(F.lit(number).cast("long").alias("batch"), "l.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(path)
