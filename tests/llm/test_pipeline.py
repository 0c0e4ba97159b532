import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm import bpe, mixing, pii, quality, queries, simhash

pytestmark = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/word_bpe_49k.json"), reason="no vocabulary here")


def test_stages_by_brute_force(spark, make_docs, prose, tmp_path):
    texts = [prose(k, 120) for k in range(60)] + [prose(3, 120), prose(4, 120) + " end", "w### x&&& " * 30, "short", None, prose(70, 120) + " mail a.b@c.de"]
    docs = make_docs(texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    rows = {r.doc_id: r for r in docs.collect()}
    kept = [r.doc_id for r in quality.judge(docs).where("kept").collect()]
    assert not {62, 63, 64} & set(kept)
    prints = {k: simhash.simhashes(rows[k].text.encode(), simhash.PRINTS) for k in kept}
    groups = {}
    for k in sorted(kept):
        near = [g for g in groups.values() if any(bin(a ^ b).count("1") <= 3 for j in g for a, b in zip(prints[k], prints[j]))]
        merged = {k}.union(*near)
        groups = {min(g): g for g in groups.values() if g not in near} | {min(merged): merged}
    assert 60 not in groups and 3 in groups
    clean = spark.createDataFrame([(k, pii.masked(rows[k].text), rows[k].lang, rows[k].source, 0) for k in groups], docs.schema)
    assert "a.b@c.de" not in clean.where("doc_id = 65").first().text
    mixed = mixing.mix(clean)[0].collect()
    with open(queries.vocabulary(), encoding="utf-8") as f:
        e = bpe.Encoder(f.read())
    assert got == sorted((r.doc_id, *e.digest(r.text)) for r in mixed)


def test_stages_keep_the_columns(spark, make_docs, prose):
    docs = make_docs([prose(k) for k in range(20)])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "personal_data", "source_mix", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.where("false"), "").collect() == []


#: Names that the stages work with inside, and a name that must be quoted.
CLASHES = [
    "id", "h", "g", "rows", "fingerprint", "own_id", "best", "root", "none", "c0", "c3", "of", "passes", "rest", "blocks", "end", "left", "pass", "block", "draw", "upto", "tokens", "key", "_source", "_pass", "_draw",
    "_block", "n_words", "n_marked", "vote_symbols", "base_failed", "kept", "posterior", "row", "__kept", "__own", "__rank", "x.y", "a b",
]


def test_stages_with_clashing_names(spark, make_docs, prose):
    """Every stage keeps every other column, values and all; with repeated rows, nulls and an empty text among them."""
    texts = [(k, prose(k, 60) + " a@b.c") for k in range(30)] + [(3, prose(3, 60) + " a@b.c"), (None, prose(4, 60)), (40, None), (41, "")]
    plain = make_docs(texts)
    docs = plain.toDF("doc_id", "text", "lang", "source", "n_chars").select("*", *[F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for k, c in enumerate(CLASHES)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert rows and all(v == f"{k}:{'?' if r[0] is None else r[0]}" for r in rows for k, v in enumerate(r[5:])), name
        assert sorted(repr(r[:5]) for r in rows) == sorted(repr(tuple(r)) for r in stage(spark, plain, "").collect()), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == len(texts)


def test_working_tables_go_once_they_are_read(spark, make_docs, prose):
    from bitloom.llm import common

    docs = make_docs([prose(k, 40) for k in range(30)])
    first = corpus_pipeline.quality_rules(spark, docs, "")
    second = corpus_pipeline.near_dedup(spark, first, "")
    assert second.count() == first.count() == 30  # first hasn't been written, so what it reads is still there
    held = [df._cut_path for df in common._left]
    corpus_pipeline.personal_data(spark, docs, "")
    assert held and common._left == [] and not any(os.path.exists(p) for p in held)
