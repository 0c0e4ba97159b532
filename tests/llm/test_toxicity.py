import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark, make_docs, prose):
    rng = random.Random(1)
    texts, labels = [], []
    for k in range(600):
        words, toxic = prose(k, 60).split(), rng.random() < 0.2
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vilewretch", "scumlord", "trashfool", "moronic"]))
        texts.append(" ".join(words))
        if k % 2 == 0:
            labels.append((k, 1, int(toxic)))
        else:
            labels.append((k, 1, None))
    truth = {k: any(w in t for w in ("vile", "scum", "trash", "moron")) for k, t in enumerate(texts)}
    return make_docs([*texts, None, ""]), spark.createDataFrame(labels, LABELS), truth


def test_held_out_documents_are_told_apart(corpus):
    docs, labels, truth = corpus
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 602 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    assert {r.predicted for r in rows if r.doc_id >= 600} == {0}


def test_held_out_labels_are_not_used(spark, corpus):
    docs, labels, _ = corpus
    turned = spark.createDataFrame([(r.doc_id, r.quality, 1 - r.toxic if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.toxic) for r in labels.collect()], LABELS)
    a = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.score(docs, turned).collect()}


def test_the_index_is_exact():
    rng = np.random.default_rng(0)
    rows = np.where(rng.random((500, 40)) < 0.1, rng.random((500, 40)), 0)
    rows /= np.maximum(np.linalg.norm(rows, axis=1), 1e-9)[:, None]
    rows[100:120] = rows[80]
    sparse = [(np.nonzero(r)[0], r[np.nonzero(r)[0]]) for r in rows]
    index = toxicity.BlockMaxIndex(sparse, 40, 16, rng.permutation(500).tolist())
    for _ in range(200):
        terms = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(terms))
        scores = np.round(rows[:, terms] @ w, 12)
        for skip in (-1, 7):
            want = [k for k in np.lexsort((np.arange(500), -scores)) if scores[k] > 0 and k != skip][:15]
            assert index.top(terms, w, 15, skip)[0].tolist() == want


def test_isotonic_is_monotone_and_weighted():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1]), np.array([1.0, 1, 1, 2, 1]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and abs(y[2] - 0.25) < 1e-12


def test_the_query_is_what_all_pairs_give(spark, make_docs, prose):
    """Frequencies, odds, vectors, cosines, votes and calibration written out plainly, every document against every example."""
    rng = random.Random(4)
    texts = [prose(k, 30) + " " + " ".join(rng.sample(["vilewretch", "vilest", "scum", "Scumlords"], 2) if k % 4 == 0 else []) for k in range(160)]
    texts += [texts[0], texts[0], "", None, "zzz unseen", "the " * 50_000, "vilewretch"]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(0, 160, 2)] + [(1, 1, 2), (3, 1, None), (None, 1, 1), (900, 1, 1), (5, 1, 1), (5, 1, 0)]
    docs = make_docs(texts).withColumn("score", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("want", F.lit(1)).withColumn("id", F.lit(0)).repartition(5)
    p = toxicity.Params(block=8, first=2)
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, LABELS), p).collect()}

    label = {}
    for i, _, y in labels:
        if y in (0, 1) and i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            label[i] = min(y, label.get(i, 1))
    learned = sorted(i for i in label if i < len(texts))
    n1 = sum(label[i] for i in learned)
    n0 = len(learned) - n1
    words = [Counter(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    heads = [sum((Counter({"^" + w[:k]: c}) for w, c in ws.items() for k in (4, 5, 6, 7) if len(w) > k), Counter()) for ws in words]
    odds = {}
    for term in {t for i in learned for t in (*words[i], *heads[i])}:
        c1 = sum(term in words[i] or term in heads[i] for i in learned if label[i])
        c0 = sum(term in words[i] or term in heads[i] for i in learned if not label[i])
        g = 2 * sum(c * math.log(c / ((c0 + c1) * n / (n0 + n1))) for c, n in ((c0, n0), (c1, n1)) if c)
        if c1 * n0 > c0 * n1 and g >= 16:
            odds[term] = math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1))
    assert any(t[0] == "^" for t in odds) and any(t[0] != "^" for t in odds)
    every = [Counter({**ws, **{h: c for h, c in hs.items() if h in odds}}) for ws, hs in zip(words, heads)]
    known = {t for i in learned for t in every[i]}
    n = len(texts)
    weight = {t: max(0.0, math.log((n + 1) / (sum(t in e for e in every) + 1))) * odds.get(t, p.floor) for t in known}

    def vector(k):
        v = {t: (1 + math.log(c)) * (weight[t] if t in known else math.log(n + 1) * p.floor) for t, c in every[k].items() if t in known or t[0] != "^"}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items() if t in known} if size else {}

    vectors = {k: vector(k) for k in range(n)}
    amount = Counter(label.values())
    each = Counter(label[i] for i in learned)
    vote = {y: amount[y] / each[y] for y in each}

    def near(k, skip=None):
        cos = [(-round(sum(x * vectors[i].get(t, 0) for t, x in vectors[k].items()), 12), at, i) for at, i in enumerate(learned) if i != skip]
        best = sorted(c for c in cos if c[0] < 0)[: p.k]
        v = [(c * c * vote[label[i]] / vote[1], label[i]) for c, _, i in best]
        return best, sum(x * y for x, y in v) / (sum(x for x, _ in v) + p.doubt) if best else None

    raws = [(near(i, i)[1], label[i], vote[label[i]]) for i in learned]
    curve = toxicity.isotonic(*(np.array(x, float) for x in zip(*(r for r in raws if r[0] is not None))))
    base = amount[1] / (amount[0] + amount[1])
    for k in range(n):
        best, raw = near(k)
        want = base if raw is None else float(np.clip(np.interp(raw, *curve), 0, 1))
        assert abs(got[k].score - want) < 1e-6, k
        assert [e.split(":")[0] for e in got[k].evidence.split(",") if e][:1] == [str(i) for _, _, i in best[:1]] or abs(best[0][0] - best[1][0]) < 1e-9, k
    assert got[160].score == got[161].score == got[0].score and got[162].evidence == got[163].evidence == ""


def test_without_labels_or_rows(spark, corpus):
    docs, labels, _ = corpus
    none = labels.where("false")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), labels).collect() == []
    assert {r.predicted for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0}
