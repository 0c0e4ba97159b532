"""Shards along a Hilbert curve; DataFrame functions only.

Four metadata columns are quantised to 4 bits each, language, source, length and id, by values that part all rows into
sixteen; these are exact, from counted distinct values.
The cell's index on a four-dimensional Hilbert curve orders the rows, and equal runs of that order are the shards, so a
shard covers few values of each column and readers can skip it by its statistics. Ranks are exact without a global
sort: at most 65,536 cells are counted and ordered, each cell is dealt into buckets of bounded size, and a row's rank is
its cell's start, plus its bucket's, plus its place there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.llm.common import cut, drop, free_name
from bitloom.operators.stats import at_ranks

BITS, DIMS = 4, 4
#: Rows of a cell that one bucket gets, about.
BUCKET = 4096
#: Rows of one written file.
FILE_ROWS = 1_000_000


def hilbert(cells: DataFrame, axes: list[str], out: str, bits: int = BITS) -> DataFrame:
    """cells with the Hilbert index of integer axes of `bits` bits each: exchange and invert, Gray code, interleave.

    The working columns x0, x1, ... and t are replaced step by step, so that no expression holds another twice.
    """
    n = len(axes)
    df = cells.select("*", *[F.col(a).cast("int").alias(f"_x{k}") for k, a in enumerate(axes)])
    x = [F.col(f"_x{k}") for k in range(n)]
    q = 1 << (bits - 1)
    while q > 1:
        for k in range(n):
            low = F.lit(q - 1)
            swap = x[0].bitwiseXOR(x[k]).bitwiseAND(low)
            high = x[k].bitwiseAND(F.lit(q)) != 0
            df = df.withColumn("_t", F.when(high, low).otherwise(swap)).withColumn("_u", F.when(high, F.lit(0)).otherwise(swap))
            df = df.withColumn("_x0", x[0].bitwiseXOR(F.col("_t")))
            if k:
                df = df.withColumn(f"_x{k}", x[k].bitwiseXOR(F.col("_u")))
        q >>= 1
    for k in range(1, n):
        df = df.withColumn(f"_x{k}", x[k].bitwiseXOR(x[k - 1]))
    df = df.withColumn("_t", reduce(Column.bitwiseXOR, [F.when(x[n - 1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)) for b in range(1, bits)]))
    df = df.select("*", *[x[k].bitwiseXOR(F.col("_t")).alias(f"_y{k}") for k in range(n)])
    picked = [F.shiftleft(F.shiftright(F.col(f"_y{k}"), b).bitwiseAND(F.lit(1)), b * n + n - 1 - k) for b in range(bits) for k in range(n)]
    index = reduce(Column.bitwiseOR, picked)
    return df.withColumn(out, index).drop("_t", "_u", *[f"_{c}{k}" for c in "xy" for k in range(n)])


def _cuts(df: DataFrame, value: str, rows: int) -> list:
    """The values that part these rows into sixteen, as near as repeated ones allow; nulls come before all of them."""
    ranks = {f"r{j}": F.col("n") - (rows - rows * j // 16) - 1 for j in range(1, 16)}
    found = at_ranks(df.select(F.lit(0).alias("g"), value), ["g"], value, **ranks).select(*ranks).first()
    return sorted({v for v in found or () if v is not None})


def _quantised(c: Column, cuts: list) -> Column:
    """How many of the cuts are below c; null is before all."""
    return F.coalesce(reduce(Column.__add__, [(c > F.lit(x)).cast("int") for x in cuts], F.lit(0)), F.lit(0))


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", strings: tuple[str, str] = ("lang", "source"), length_col: str = "n_chars") -> DataFrame:
    """Per row of docs: id, size, text_crc32, law, shard, slot, grown_shard and the curve index.

    The law is `rows`: shards' counts differ by one at most. size: bytes of the text (null: none) plus 1. Rows of one
    cell are ordered by the hash of their id, then id, checksum and size; rows that agree in all are alike, so any order
    of them is the same result. Null metadata come first; an empty table gives no rows; other columns don't matter,
    whatever their names. The cuts come from all rows, so reruns give the same shards.
    """
    name = lambda c: F.col(f"`{c}`")
    text = F.coalesce(name(text_col), F.lit("")).cast("binary")
    number = lambda c: F.xxhash64(name(c)) if docs.schema[c].dataType.simpleString() == "string" else name(c).cast("long")
    whole = docs.select(name(id_col).alias("id"), *[name(c).cast("string").alias(f"x{k}") for k, c in enumerate(strings)], name(length_col).cast("long").alias("x2"), number(id_col).alias("x3"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"))
    whole = cut(whole)
    rows = whole.count()
    cell = reduce(lambda s, a: s * 16 + a, [_quantised(F.col(f"x{k}"), _cuts(whole, f"x{k}", rows)) for k in range(DIMS)])
    slim = cut(whole.select("id", "size", "crc", cell.alias("cell")))
    drop(whole)

    counted = slim.groupBy("cell").agg(F.count("*").alias("n"))
    counted = counted.select("cell", "n", *[F.shiftright("cell", 4 * (DIMS - 1 - k)).bitwiseAND(F.lit(15)).alias(f"a{k}") for k in range(DIMS)])
    cells = cut(hilbert(counted, [f"a{k}" for k in range(DIMS)], "curve").select("cell", "n", "curve"))
    total = cells.agg(F.sum("n")).first()[0] or 0
    # 65,536 rows at most meet here
    cells = cells.withColumn("start", F.sum("n").over(W.orderBy("curve").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    cells = cells.withColumn("buckets", F.ceil(F.col("n") / BUCKET))
    placed = slim.join(F.broadcast(cells.drop("n")), "cell")
    placed = placed.withColumn("hash", F.xxhash64("id", "crc")).withColumn("bucket", F.pmod("hash", "buckets"))
    sums = placed.groupBy("cell", "bucket").agg(F.count("*").alias("m"))
    sums = sums.select("cell", "bucket", (F.sum("m").over(W.partitionBy("cell").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("m")).alias("before"))
    inside = W.partitionBy("cell", "bucket").orderBy("hash", "id", "crc", "size")
    ranked = placed.join(sums, ["cell", "bucket"]).withColumn("rank", F.col("start") + F.col("before") + F.row_number().over(inside) - 1)
    ranked = ranked.withColumn("shard", F.expr(f"cast((rank * {n_shards}) div {max(1, total)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")
    return ranked.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """docs as one folder per shard, whose files in the order of their names hold its rows in slot order. placed: id, shard
    and slot of shards(), ids unique. Runs of slots go to as many tasks as the rows ask for, whatever the shards' number.
    The folders carry the shard's number, under the name shard, or shard_1 and so on where docs has that."""
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    kept = free_name(docs, "shard")
    where = placed.select(F.col(f"`{id_col}`").alias("id"), F.col("shard").alias("to"), "slot")
    files = max(1, -(-placed.count() // FILE_ROWS))
    rows = docs.toDF(*at.values()).join(where, F.col(at[id_col]) == F.col("id"))
    rows = rows.repartitionByRange(files, "to", "slot").sortWithinPartitions("to", "slot").select(*at.values(), "to")
    rows.toDF(*docs.columns, kept).write.partitionBy(kept).parquet(path)
