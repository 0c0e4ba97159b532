import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import sharding


@pytest.mark.parametrize("n", [1, 7, 8, 100, 1003])
def test_the_law_of_rows(spark, make_docs, n, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 16)
    texts = [None, "", "é", "x"] * n
    docs = make_docs([(k if k % 5 else 5, texts[k]) for k in range(n)]).withColumn("lang", F.when(F.col("doc_id") % 4 == 1, None).otherwise("en")).withColumn("cell", F.lit("clash")).withColumn("size", F.lit("clash"))
    rows = sharding.shards(docs).collect()
    assert len(rows) == n and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    want = sorted((k if k % 5 else 5, len((texts[k] or "").encode()) + 1, zlib.crc32((texts[k] or "").encode())) for k in range(n))
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_the_curve_visits_every_cell_by_single_steps(spark):
    axes = ["a", "b", "c", "d"]
    df = spark.range(65536).select(*[F.shiftright("id", 4 * k).bitwiseAND(F.lit(15)).alias(c) for k, c in enumerate(axes)])
    h = sharding.hilbert(df, axes, "h").toPandas().sort_values("h")
    assert (h.h.to_numpy() == np.arange(65536)).all()
    assert (np.abs(np.diff(h[axes].to_numpy(), axis=0)).sum(1) == 1).all()


def test_shards_hold_less_than_random_ones(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("l"), F.pmod(F.xxhash64("id"), F.lit(4))).alias("lang"), F.concat(F.lit("source"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(16))).alias("source"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10_000)).alias("n_chars"))
    placed = df.drop("text").join(sharding.shards(df), "doc_id").toPandas()
    spread = placed.groupby("shard").n_chars.agg(lambda x: x.max() - x.min()).mean() * placed.groupby("shard").doc_id.agg(lambda x: x.max() - x.min()).mean() * placed.groupby("shard").source.nunique().mean() * placed.groupby("shard").lang.nunique().mean()
    assert spread < 0.35 * 10_000 * 4000 * 16 * 4


def test_written_shards_are_read_back(spark, make_docs, tmp_path):
    docs = make_docs([(k, f"t{k}") for k in range(50)])
    sharding.write_shards(docs, sharding.shards(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(k, f"t{k}") for k in range(50)]
    assert back.select("shard").distinct().count() == 4


def test_an_empty_table_and_no_python(make_docs):
    docs = make_docs([(1, "x")])
    assert sharding.shards(docs.where("false")).collect() == []
    plan = sharding.shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shards_row_by_row(spark, make_docs, xxhash64, monkeypatch):
    """Cuts, cells, ranks, shards and slots by plain loops; the curve's own order is tested above. With a hot text."""
    monkeypatch.setattr(sharding, "BUCKET", 7)
    rows = [(k if k % 7 else None, [None, "", "same", f"text {k} é"][k % 4], [None, "en", "de", "x" * 9 + str(k % 5)][k % 4], f"source-with-a-long-name-{k % 23}", k % 50 if k % 9 else None) for k in range(400)] + [(5, "same", "en", "hot", 1)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("x0", F.lit(1)).withColumn("crc", F.lit("clash"))
    cuts = []
    for k in (2, 3, 4, 0):
        values = sorted((r[k] for r in rows), key=lambda v: (v is not None, v if v is not None else 0))
        cuts.append(sorted({values[len(rows) * j // 16 - 1] for j in range(1, 16) if values[len(rows) * j // 16 - 1] is not None}))
    cells = [tuple(sum(r[k] is not None and r[k] > c for c in cs) for k, cs in zip((2, 3, 4, 0), cuts)) for r in rows]
    axes = ["a", "b", "c", "d"]
    curve = {tuple(r[:4]): r.h for r in sharding.hilbert(spark.createDataFrame(sorted(set(cells)), "a int, b int, c int, d int"), axes, "h").collect()}
    size = {c: cells.count(c) for c in set(cells)}
    keyed = []
    for r, c in zip(rows, cells):
        data = (r[1] or "").encode()
        crc = zlib.crc32(data)
        h = xxhash64(r[0], crc)
        keyed.append((curve[c], h % -(-size[c] // 7), h, (r[0] is not None, r[0] or 0), crc, len(data) + 1, r[0]))
    keyed.sort()
    want, first = [], {}
    for rank, (at, _, _, _, crc, n, i) in enumerate(keyed):
        shard = rank * 8 // len(keyed)
        want.append((i, n, crc, shard, rank - first.setdefault(shard, rank), at))
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.curve) for r in sharding.shards(docs).collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_shards_of_a_hot_cell_are_written_by_many_tasks(spark, make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_ROWS", 20)
    docs = make_docs([(k, "same") for k in range(200)]).withColumn("shard", F.lit("clash")).withColumn("to", F.col("doc_id")).withColumn("x.y", F.lit(1))
    placed = sharding.shards(docs, 2)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*docs.columns, "shard_1"] and back.count() == 200 and len(list(tmp_path.glob("out/shard_1=0/*.parquet"))) >= 4
    slots = {r.doc_id: (r.shard, r.slot) for r in placed.collect()}
    for folder in (0, 1):
        rows = [r.doc_id for f in sorted(tmp_path.glob(f"out/shard_1={folder}/*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        assert [slots[i] for i in rows] == [(folder, k) for k in range(100)]


def test_cuts_part_all_rows_and_not_a_sample(spark):
    """65,536 ids and nothing else to part them: each sixteenth is one cell, to the row."""
    docs = spark.range(65_536).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("n_chars"))
    assert [r["count"] for r in sharding.shards(docs).groupBy("curve").count().collect()] == [4096] * 16
