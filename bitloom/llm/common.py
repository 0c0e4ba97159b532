"""Helpers shared by the operators: table access, lineage cuts, bounded walks over long texts."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import lineage
from bitloom.operators.lineage import drop, shared_dir  # noqa: F401
from bitloom.sources.shipping import ship

#: Bytes of text that are split into words at a time.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What the running pipeline stage has cut, if one runs, and what earlier stages have left.
_made: list[DataFrame] | None = None
_left: list[DataFrame] = []


def cut(df: DataFrame) -> DataFrame:
    """lineage.cut(), remembered where a pipeline stage runs."""
    out = lineage.cut(df)
    if _made is not None:
        _made.append(out)
    return out


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A pipeline stage that deletes the working tables of the stages before it, as their results have been written by then;
    those that its docs are still read from stay."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _made
        used = docs.inputFiles() if _left else []
        for df in [x for x in _left if not any(f"{x._cut_path}/" in name for name in used)]:
            drop(df)
            _left.remove(df)
        before, _made = _made, []
        try:
            return f(spark, docs, sf_dir)
        finally:
            _left.extend(x for x in _made if x._cut_path)
            _made = before

    return run


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where its files give half as many tasks as there are cores or fewer; for work on texts that costs
    more than moving them. A large table has more parts than that, and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has, whatever its case."""
    held = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in held:
        n += 1
        name = f"{stem}_{n}"
    return name


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """left.join(right, key) where one key may hold a large part of left. right holds a key once; hot holds the keys that
    are frequent, few by how they were chosen: their rows meet right by broadcast, the others by a shuffle."""
    few = F.broadcast(hot.select(key))
    return left.join(F.broadcast(right.join(few, key, "left_semi")), key).unionByName(left.join(few, key, "left_anti").join(right, key))


#: A key is frequent if it has more than this many rows and more than a 1,000th of all, so that there are under 1,000.
FREQUENT = 256


def frequent(rows: int) -> int:
    """The number of rows above which a key is frequent, of so many rows in all."""
    return max(FREQUENT, rows // 1000)


_held: dict[str, Any] = {}


def hold(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives value in a worker. What travels and stays are its bytes; a worker keeps one such value built,
    as reused workers would otherwise gather the models of all earlier jobs with all that those have cached."""
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(value))

    def take() -> Any:
        from bitloom.llm import common

        if key not in common._held:
            common._held.clear()
            common._held[key] = pickle.loads(sent.value)
        return common._held[key]

    return take


def word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of data, in order, in lists that each come from about CHUNK bytes.

    A word is a run of bytes other than space, tab and the line breaks 0x0A to 0x0D.
    """
    if len(data) <= CHUNK:
        yield data.split()
        return
    at, tail = 0, b""
    while at < len(data):
        piece = tail + data[at : at + CHUNK]
        at += CHUNK
        words = piece.split()
        if at < len(data) and words and not piece[-1:].isspace():
            tail = words.pop()
        else:
            tail = b""
        yield words
    if tail:
        yield [tail]


def held_out(doc_id, mod: int, rest: int):
    """True where crc32 of the id, written as text, leaves this remainder; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == rest
