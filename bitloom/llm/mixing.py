"""Mixing sources by temperature.

A source's weight is its share of the tokens raised to an exponent. The exponent is bisected between 0 (all sources
alike) and 1 (as they come) to the flattest mix that repeats no source more than a limit, or to a target entropy. The
weights times the token budget say how often a source is passed over: whole passes take all of its documents, and the
last, partial pass takes blocks of a permutation until its budget is met. Every pass has a permutation of its own, by
hashes, in blocks of bounded size; only the block that the budget cuts is ever ordered row by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.llm.common import cut, free_name
from bitloom.operators.sizing import small

#: Sources are a list that people keep; one row of each meets on the driver, and goes to every task. More is an error.
MAX_SOURCES = 100_000
#: Rows of a table of keys that may be broadcast.
FEW_KEYS = 500_000
_TOKENS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Params:
    """budget: tokens of the mix, as a multiple of all tokens. max_passes, entropy: one is set; entropy is a share of log(sources)."""

    budget: float = 1.0
    max_passes: float | None = 2.0
    entropy: float | None = None
    block: int = 4096
    seed: int = 11


def weights_at(shares: list[float], exponent: float) -> list[float]:
    """Normalised shares ** exponent; a share of 0 has weight 0."""
    top = max((math.log(s) for s in shares if s > 0), default=0.0)
    raised = [math.exp(exponent * (math.log(s) - top)) if s > 0 else 0.0 for s in shares]
    total = sum(raised) or 1.0
    return [r / total for r in raised]


def _entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def solve(shares: list[float], p: Params) -> float:
    """The exponent in [0, 1]: the least whose passes stay within max_passes, or the one whose entropy is the target.

    1 where even the natural mix passes the limit; 0 where the flattest mix keeps within it or is short of the entropy.
    """
    live = [s for s in shares if s > 0]
    if p.entropy is not None:
        goal = p.entropy * math.log(len(live)) if live else 0.0
        fits = lambda e: _entropy(weights_at(live, e)) <= goal
    else:
        fits = lambda e: all(w * p.budget <= p.max_passes * s * (1 + 1e-12) for w, s in zip(weights_at(live, e), live))
    if not live or fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


@dataclass(frozen=True)
class Share:
    """A source's part: its documents and tokens, the weight, the tokens wanted, whole passes and the rest of the last."""

    source: str | None
    docs: int
    tokens: int
    weight: float
    wanted: int
    passes: int
    rest: int


def plan(stats: list[tuple], p: Params) -> list[Share]:
    """stats: (source, documents, tokens). Sources without tokens are passed over once, whole."""
    stats = sorted(stats, key=lambda s: (s[0] is None, s[0]))
    total = sum(s[2] for s in stats)
    shares = [s[2] / total if total else 0.0 for s in stats]
    w = weights_at(shares, solve(shares, p))
    out = []
    for (source, docs, tokens), x in zip(stats, w):
        wanted = round(x * p.budget * total)
        if p.max_passes is not None and p.entropy is None:
            wanted = min(wanted, math.floor(p.max_passes * tokens)) if p.budget <= p.max_passes else wanted
        passes, rest = divmod(wanted, tokens) if tokens else (1, 0)
        out.append(Share(source, docs, tokens, x, wanted, passes, rest))
    return out


def _draw(key: Column, passed: Column, seed: int) -> Column:
    return F.xxhash64(key, passed, F.lit(seed))


def _block(draw: Column, blocks: Column) -> Column:
    return F.pmod(F.shiftright(draw, 16), blocks)


def mix(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, list[Share]]:
    """docs as often as the mix takes them, with pass, block and draw (the order within a block); and the plan.

    Tokens are words between white space. The realised tokens of a source fall short of its budget by less than one
    document. Null is a source of its own; null texts count as empty; rows that agree in id and text share a place.
    An empty table gives an empty mix. Columns of docs that are named pass, block or draw keep their names and values,
    and these get a number behind; other names don't matter. Over MAX_SOURCES sources are an error.
    """
    p = params
    spark = docs.sparkSession
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*at.values())
    tokens = F.coalesce(F.regexp_count(F.col(at[text_col]), F.lit(_TOKENS)), F.lit(0)).cast("long")
    key = F.xxhash64(F.col(at[id_col]), F.col(at[text_col]))
    slim = cut(rows.select(F.col(at[source_col]).alias("source"), tokens.alias("tokens"), key.alias("key")))
    totals = slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    shares = plan([(r.source, r.n, r.t) for r in totals], p)
    kind = docs.schema[source_col].dataType.simpleString()
    parts = spark.createDataFrame([(s.source, s.passes, s.rest, max(1, -(-s.docs // p.block))) for s in shares], f"of {kind}, passes long, rest long, blocks long")

    # the block that the partial pass of each source ends in, and what is left for it
    last = slim.join(F.broadcast(parts), F.col("source").eqNullSafe(F.col("of"))).where("rest > 0")
    sums = last.groupBy("of", "rest", _block(_draw(F.col("key"), F.col("passes"), p.seed), F.col("blocks")).alias("b")).agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(W.partitionBy("of").orderBy("b").rowsBetween(W.unboundedPreceding, 0))
    ends = {r.of: (r.b, r.left) for r in sums.withColumn("left", F.col("rest") - upto + F.col("t")).where((F.col("left") >= 0) & (F.col("left") < F.col("t"))).groupBy("of").agg(F.max_by("b", "b").alias("b"), F.max_by("left", "b").alias("left")).collect()}
    parts = spark.createDataFrame([(s.source, s.passes, s.rest, max(1, -(-s.docs // p.block)), *ends.get(s.source, (None, None))) for s in shares], f"of {kind}, passes long, rest long, blocks long, end long, left long")

    taken = rows.join(F.broadcast(parts), F.col(at[source_col]).eqNullSafe(F.col("of")))
    count = F.col("passes") + (F.col("rest") > 0).cast("long")
    taken = taken.where(count > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("pass"))
    taken = taken.withColumn("draw", _draw(key, F.col("pass"), p.seed)).withColumn("block", _block(F.col("draw"), F.col("blocks")))
    partial = F.col("pass") == F.col("passes")
    whole = taken.where(~partial | F.col("end").isNull() | (F.col("block") < F.col("end")))

    # what the budget takes of the block that it cuts is told by keys, so that no text is ordered or shuffled
    cut_block = slim.join(F.broadcast(parts), F.col("source").eqNullSafe(F.col("of"))).where("end is not null").withColumn("draw", _draw(F.col("key"), F.col("passes"), p.seed)).where(_block(F.col("draw"), F.col("blocks")) == F.col("end"))
    upto = F.sum("tokens").over(W.partitionBy("of").orderBy("draw", "key").rowsBetween(W.unboundedPreceding, 0))
    chosen = cut_block.withColumn("upto", upto).groupBy(F.col("of").alias("from"), F.col("key").alias("place")).agg(F.count("*").alias("held"), F.sum((F.col("upto") <= F.col("left")).cast("long")).alias("kept"))
    chosen = small(cut(chosen.where("kept > 0")), FEW_KEYS)
    edge = taken.where(partial & (F.col("block") == F.col("end"))).withColumn("place", key).join(chosen, ["place"]).where(F.col("of").eqNullSafe(F.col("from")))
    # of rows that agree in id and text as many as are kept: one place a source at most
    some = edge.where("kept < held").withColumn("n", F.row_number().over(W.partitionBy("of", "place").orderBy("draw"))).where("n <= kept").drop("n")
    edge = edge.where("kept = held").unionByName(some).select(*whole.columns)
    out = whole.unionByName(edge).select(*at.values(), "pass", "block", "draw")
    return out.toDF(*docs.columns, *(free_name(docs, stem) for stem in ("pass", "block", "draw"))), shares
