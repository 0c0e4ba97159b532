import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bitloom.llm import simhash
from bitloom.llm.components import connected


def plain(text):
    """The contract, word for word."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """{fingerprint: smallest id of its class} by comparing all pairs; prints: (id, fingerprint)."""
    up = {f: f for _, f in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(up)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(a ^ b).count("1") <= 3:
                up[top(a)] = top(b)
    least = {}
    for i, f in prints:
        least[top(f)] = min(i, least.get(top(f), i))
    return {f: least[top(f)] for f in keys}


TEXTS = ["", None, "   ", "One", "one two", "ONE TWO three", "a b c d", "Ünï ça x y\x1cz w", "İ K x", "same words here again", "same words here again", "x " * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_is_the_contract(text):
    assert simhash.simhash((text or "").encode()) == plain(text)


def test_long_texts_are_taken_whole(monkeypatch, prose):
    text = prose(1, 4000)
    want = plain(text)
    monkeypatch.setattr("bitloom.llm.common.CHUNK", 97)
    assert simhash.simhash(text.encode()) == want


def test_classes_match_all_pairs(spark, make_docs, prose):
    rng = random.Random(4)
    texts = [prose(k, 120) for k in range(30)]
    for k in range(60):
        words = texts[rng.randrange(30)].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(["new", "other", "odd"])
        texts.append(" ".join(words))
    texts += TEXTS
    docs = make_docs(texts).withColumn("fingerprint", F.lit("clash")).withColumn("u", F.lit(1))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.dedup_classes(docs).collect()}
    assert len(got) == len(texts)
    prints = [(k, plain(t)) for k, t in enumerate(texts)]
    want = classes(prints)
    assert got == {k: (f, want[f]) for k, f in prints}


def test_near_fingerprints_are_all_found_and_dense_cells_too(spark, monkeypatch):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for f in base:
        for n in (1, 2, 3, 4, 5):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            prints.add(g)
    rows = sorted(prints)
    signed = [int(np.uint64(x).astype(np.int64)) for x in rows]
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    want = {frozenset((a, b)) for i, a in enumerate(rows) for b in rows[:i] if bin(a ^ b).count("1") <= 3}
    got = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.links(df).collect()}
    assert got == want
    monkeypatch.setattr(simhash, "DENSE", 1)
    monkeypatch.setattr(simhash, "BLOCK", 2)
    by_block = classes([(k, f) for k, f in enumerate(rows)])
    ids = spark.createDataFrame([(k, s) for k, s in enumerate(signed)], "doc_id long, fingerprint long")
    found = {r.fingerprint % 2**64: r.component_id for r in simhash.classes(ids).collect()}
    assert found == by_block


def test_components_of_chains_and_random_graphs(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(200)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5, 5)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: top(x) for x in up if top(x) != x}


def test_one_row_of_each_class_stays(make_docs, prose):
    a, b = prose(1), prose(2)
    docs = make_docs([(7, a), (3, a), (3, a), (9, b), (3, b), (None, prose(3)), (1, None)])
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_first(docs).collect()), key=repr)
    assert kept == sorted([(3, a), (3, b), (None, prose(3)), (1, None)], key=repr)
    assert simhash.keep_first(docs).columns == docs.columns


def test_an_empty_table_gives_nothing(make_docs):
    docs = make_docs([(1, "x")]).where("false")
    assert simhash.dedup_classes(docs).collect() == [] and simhash.keep_first(docs).collect() == []


def test_near_copies_by_several_prints(spark, make_docs, prose):
    """The operator against all pairs of all of three prints, and how many near copies it takes."""
    rng = random.Random(12)
    texts = [prose(k, 120) for k in range(150)]
    for k in range(150):
        words = texts[k].split()
        words[rng.randrange(len(words))] = f"changed{k}"
        texts.append(" ".join(words))
    texts += ["", "one", "one two", None, "   "]
    prints = [simhash.simhashes((t or "").encode(), 3) for t in texts]
    assert [p[0] for p in prints] == [plain(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if any(bin(a ^ b).count("1") <= 3 for a, b in zip(prints[i], prints[j])):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    docs = make_docs(texts)
    kept = {r.doc_id for r in simhash.keep_first(docs, prints=3).collect()}
    assert kept == {k for k in range(len(texts)) if top(k) == k}
    one = simhash.keep_first(docs, prints=1).count()
    assert len(kept) < one and sum(k in kept for k in range(150, 300)) < 0.3 * 150
