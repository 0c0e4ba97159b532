import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitloom.llm import mixing


def docs_of(spark, make_docs, prose):
    texts = [(k, prose(k, 5 + k % 40)) for k in range(600)] + [(5, prose(5, 10)), (601, None), (602, "")]
    source = F.when(F.col("doc_id") % 20 == 0, "rare").when(F.col("doc_id") % 3 == 0, "some").when(F.col("doc_id") == 7, F.lit(None)).otherwise("hot")
    return make_docs(texts).withColumn("source", source).withColumn("pass", F.lit("clash"))


@pytest.fixture(scope="module")
def docs(spark, make_docs, prose):
    return docs_of(spark, make_docs, prose).cache()


@pytest.mark.parametrize("params", [{}, {"block": 7}, {"max_passes": 3.5, "block": 7}, {"max_passes": None, "entropy": 0.8, "block": 5}, {"budget": 0.3, "block": 3}, {"budget": 1.9, "block": 50}])
def test_the_mix_keeps_its_plan(docs, params):
    p = mixing.Params(**params)
    mixed, plan = mixing.mix(docs, p)
    rows = mixed.collect()
    tokens = lambda t: len((t or "").split())
    longest = max(tokens(r.text) for r in docs.collect())
    got, each = Counter(), Counter()
    for r in rows:
        got[r.source] += tokens(r.text)
        each[r.doc_id, r.text, r.source, r.pass_1] += 1
    held = Counter((r.doc_id, r.text, r.source) for r in docs.collect())
    assert all(n <= held[k[:3]] for k, n in each.items())
    for s in plan:
        assert 0 <= s.wanted - got[s.source] < longest + 1 or s.tokens == 0
        whole = Counter((r.doc_id, r.text) for r in rows if r.source == s.source and r.pass_1 < s.passes)
        assert all(whole[k[:2]] == n * s.passes for k, n in held.items() if k[2] == s.source)
        if p.max_passes and p.entropy is None:
            assert s.wanted <= p.max_passes * s.tokens
    assert sum(s.wanted for s in plan) == pytest.approx(p.budget * sum(s.tokens for s in plan), abs=5)


def test_the_exponent():
    shares = [0.7, 0.2, 0.1]
    e = mixing.solve(shares, mixing.Params(max_passes=2.0))
    assert max(w / s for w, s in zip(mixing.weights_at(shares, e), shares)) == pytest.approx(2.0, rel=1e-6)
    e = mixing.solve(shares, mixing.Params(max_passes=None, entropy=0.9))
    w = mixing.weights_at(shares, e)
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.9 * math.log(3), rel=1e-6)
    assert mixing.solve(shares, mixing.Params(max_passes=100)) == 0 and mixing.solve([], mixing.Params()) == 0
    assert mixing.solve(shares, mixing.Params(max_passes=0.5)) == 1 and mixing.weights_at([1.0, 0.0], 0.0) == [1.0, 0.0]


def test_reruns_agree_and_passes_differ(docs):
    p = mixing.Params(max_passes=4.0, block=5)
    one = sorted((r.doc_id, r.pass_1, r.block, r.draw) for r in mixing.mix(docs, p)[0].collect() if r.doc_id != 5)
    two = sorted((r.doc_id, r.pass_1, r.block, r.draw) for r in mixing.mix(docs.repartition(7), p)[0].collect() if r.doc_id != 5)
    assert one == two
    order = lambda k: [r[0] for r in sorted((x for x in one if x[1] == k and x[0] % 20 == 0), key=lambda x: x[2:])]
    second = order(1)
    assert 5 < len(second) and [k for k in order(0) if k in second] != second


def test_an_empty_table(docs):
    mixed, plan = mixing.mix(docs.where("false"))
    assert mixed.collect() == [] and plan == []


@pytest.mark.parametrize("params", [{}, {"block": 16}, {"max_passes": 3.5, "block": 9}, {"budget": 0.4, "block": 20}])
def test_the_mix_row_by_row(docs, xxhash64, params):
    """Every row that is taken, its pass, block and draw, by a plain loop over the sources' documents."""
    p = mixing.Params(**params)
    mixed, _ = mixing.mix(docs, p)
    got = Counter((r.doc_id, r.text, r.source, r.pass_1, r.block, r.draw) for r in mixed.collect())
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    tokens = lambda t: len((t or "").split())
    total = sum(tokens(t) for _, t, _ in rows)
    stats = {s: sum(tokens(t) for _, t, x in rows if x == s) for _, _, s in rows}
    # the flattest exponent that keeps within the limit, by a fine scan
    def over(e):
        raised = {s: n**e for s, n in stats.items()}
        return any(w / sum(raised.values()) * p.budget * total > p.max_passes * stats[s] * (1 + 1e-9) for s, w in raised.items())
    low, high = 0.0, 1.0
    for _ in range(80) if over(0.0) else ():
        low, high = ((low + high) / 2, high) if over((low + high) / 2) else (low, (low + high) / 2)
    e = high if over(0.0) else 0.0
    raised = {s: n**e for s, n in stats.items()}
    want = Counter()
    for s, n in stats.items():
        wanted = min(round(raised[s] / sum(raised.values()) * p.budget * total), math.floor(p.max_passes * n))
        own = [(i, t) for i, t, x in rows if x == s]
        blocks = -(-len(own) // p.block)
        left = wanted
        for k in range(wanted // n + 1):
            order = sorted((((d := xxhash64(xxhash64(i, t), k, [p.seed])) >> 16) % blocks, d, i, t or "", t) for i, t in own)
            for b, d, i, _, t in order:
                if k < wanted // n or tokens(t) <= left:
                    want[i, t, s, k, b, d] += 1
                    left -= tokens(t) if k == wanted // n else 0
                else:
                    break
            if k < wanted // n:
                left -= n
    assert got == want


def test_repeated_rows_and_a_source_of_one_document(spark, make_docs, prose):
    rows = make_docs([(1, prose(1, 10))] * 40 + [(2, prose(2, 10))]).withColumn("source", F.when(F.col("doc_id") == 1, "copies").otherwise("one"))
    mixed, plan = mixing.mix(rows, mixing.Params(block=4))
    taken = Counter((r.source, r["pass"]) for r in mixed.collect())
    assert sum(s.tokens for s in plan) == 410 and taken["one", 0] == 1 and taken["one", 1] == 1 and taken["copies", 0] == 39
