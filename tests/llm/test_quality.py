import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = W.findall(text or "")
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    number = Counter(windows)
    again = {w for w in windows if number[w] > 1}
    inside = {k + j for k, w in enumerate(windows) if w in again for j in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n)


def test_signals_and_base_match_the_contract(make_docs, prose):
    loop = " ".join(f"w{k % 9}" for k in range(60))
    texts = [None, "", " \n\t", "a b c", "Ä ß x \x1c y", prose(1), prose(1) + "\n" + prose(1), loop, "x\nx\n\nx \ny", "# " * 30, "one two three four five six seven eight " * 2 + prose(5), prose(3, 3000)]
    docs = make_docs(texts).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect()}
    assert got == {k: base(t) for k, t in enumerate(texts)}


def test_repeated_words_by_all_windows():
    rng = np.random.default_rng(0)
    for n in (0, 5, 8, 9, 16, 40, 200):
        for kinds in (1, 2, 3, 30):
            ids = rng.integers(0, kinds, n)
            assert quality.repeated_words(ids) == base(" ".join(f"w{k}" for k in ids))[4]


def test_junk_goes_and_clean_documents_stay(make_docs, prose):
    clean = [prose(k) for k in range(300)]
    junk = [" ".join(w + "###" for w in prose(1000 + k).split()) for k in range(30)] + [" | ".join(prose(2000 + k).replace(".", "").split()) for k in range(20)]
    shout = [" ".join(w.upper() + "!!" for w in prose(3000 + k).split()) for k in range(20)]
    docs = make_docs(clean + junk + shout + [None, "short"])
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert kept == set(range(len(clean)))
    stage = quality.keep_good(docs)
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == kept


FALSE = [0.01, 0.05, 0.1, 0.15, 0.2]


def planted(kinds, shares, n=40_000, seed=1):
    """Votes of n documents: kinds[k] are the accusation rates of kind k, of which there are shares[k]; a fifth abstains."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(len(kinds), n, p=shares)
    said_bad = rng.random((n, len(kinds[0]))) < np.array(kinds)[kind]
    return kind, np.where(rng.random(said_bad.shape) < 0.8, np.where(said_bad, -1, 1), 0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_fit_recovers_planted_rates(seed):
    """False accusations of 1 to 20 %, far from any constant of the operator, and what all-must-pass would do."""
    kind, votes = planted([FALSE, [0.7] * 5], [0.85, 0.15], seed=seed)
    rows, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    m = quality.fit_votes(list("abcde"), rows, counts.astype(float))
    good = [r for r, bad in zip(m.rates, m.junk) if not bad]
    junk = [r for r, bad in zip(m.rates, m.junk) if bad]
    assert len(good) == len(junk) == 1 and abs(m.prior - 0.85) < 0.02
    assert np.allclose(good[0], FALSE, atol=0.02) and np.allclose(junk[0], 0.7, atol=0.04)
    keep = verdicts(m, rows)[back]
    truth = quality.VoteModel(m.names, (0.85, 0.15), (False, True), (tuple(FALSE), (0.7,) * 5))
    assert (keep == verdicts(truth, rows)[back]).mean() > 0.985 and keep[kind == 0].mean() > 0.97
    assert (keep & (votes == -1).any(1)).sum() > 5_000


def verdicts(m, rows):
    """The posterior's verdict by a plain loop."""
    out = []
    for row in rows:
        weight = [s * np.prod([r if v == -1 else 1 - r if v == 1 else 1.0 for v, r in zip(row, rates)]) for s, rates in zip(m.shares, m.rates)]
        out.append(sum(w for w, bad in zip(weight, m.junk) if not bad) >= 0.5 * sum(weight))
    return np.array(out)


def test_several_kinds_of_junk_are_found():
    kinds = [[0.02] * 9, *([0.85 if r // 3 == k else 0.02 for r in range(9)] for k in range(3))]
    kind, votes = planted(kinds, [0.9, 0.05, 0.03, 0.02])
    rows, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    m = quality.fit_votes(list("abcdefghi"), rows, counts.astype(float))
    assert sum(m.junk) == 3 and np.allclose(sorted(m.shares), [0.02, 0.03, 0.05, 0.9], atol=0.004)
    keep = verdicts(m, rows)[back]
    truth = quality.VoteModel(m.names, (0.9, 0.05, 0.03, 0.02), (False, True, True, True), tuple(map(tuple, kinds)))
    assert (keep == verdicts(truth, rows)[back]).mean() > 0.99 and keep[kind == 0].mean() > 0.99


def test_a_rule_that_no_other_bears_out_convicts_nobody():
    rng = np.random.default_rng(5)
    votes = np.ones((20_000, 4), int)
    votes[rng.random(20_000) < 0.1, 0] = -1
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    assert not any(quality.fit_votes(list("abcd"), rows, counts.astype(float)).junk)


def test_no_prior_grows_with_the_corpus():
    """Expected counts of all patterns, of ten thousand documents and of ten thousand millions: the latter give the truth."""
    rows = np.array(np.meshgrid(*[[-1, 1]] * 5)).reshape(5, -1).T
    share = sum(s * np.prod(np.where(rows == -1, r, 1 - np.array(r)), axis=1) for s, r in ((0.85, FALSE), (0.15, [0.7] * 5)))
    for n, close in ((1e4, 0.02), (1e10, 2e-3)):
        m = quality.fit_votes(list("abcde"), rows, share * n)
        assert np.allclose(m.rates[m.junk.index(False)], FALSE, atol=close) and np.allclose(m.rates[m.junk.index(True)], 0.7, atol=close)


@pytest.fixture(scope="module")
def judged(make_docs, prose):
    clean = [prose(k, 60 + k % 50) for k in range(200)]
    junk = [" ".join(w + "###" for w in prose(500 + k).split()) for k in range(20)]
    odd = [prose(700 + k) + "\nthe end\nthe end\nthe end\nthe end" for k in range(3)]
    texts = clean + junk + odd + [None, "", "few words", "x" * 300_000, prose(9, 60_000)]
    return texts, {r.doc_id: r for r in quality.judge(make_docs(texts)).collect()}


def test_kept_is_what_a_plain_fit_and_loop_say(judged):
    """The whole query against votes written out, counted and judged row by row."""
    texts, got = judged
    votes = []
    for t in texts:
        n = dict(zip(quality.SIGNALS, quality.signals_of(t)))
        w, a, lines = n["n_words"], n["n_letters"], n["n_lines"] if n["n_lines"] > 1 else 0
        part = lambda k, whole: n[k] / whole if whole else None
        say = lambda x, bad, good: 0 if x is None else -1 if bad(x) else 1 if good(x) else 0
        votes.append((
            say(part("n_symbols", w), lambda x: x > 0.1, lambda x: x < 0.02), say(part("n_repeat_words", w), lambda x: x > 0.3, lambda x: x < 0.05 and w >= 16),
            say(part("n_dup_lines", lines), lambda x: x > 0.3, lambda x: x < 0.1), say(part("n_upper", a), lambda x: x > 0.5, lambda x: x < 0.2),
            say(part("n_exclaim", w), lambda x: x > 0.25, lambda x: x < 0.05), say(part("word_chars", w), lambda x: x < 2.2 or x > 16, lambda x: 3 <= x <= 12),
            say(part("n_distinct", w**0.5), lambda x: x < 1.5, lambda x: x > 2.5 and w >= 20), say(part("n_enders", w), lambda x: x == 0 and w >= 60, lambda x: 0.01 < x < 0.5),
            say(part("n_bare", w), lambda x: x > 0.2, lambda x: x < 0.05), say(part("n_stutter", w), lambda x: x > 0.2, lambda x: x < 0.05 and w >= 10),
            say(w or None, lambda x: x < 5, lambda x: x >= 30), say(part("n_letters", n["word_chars"]), lambda x: x < 0.75, lambda x: x > 0.85), say(part("n_marked", w), lambda x: x > 0.1, lambda x: x < 0.02),
        ))
    failed = [base(t)[5] for t in texts]
    rows, counts = np.unique([v for v, f in zip(votes, failed) if not f], axis=0, return_counts=True)
    m = quality.fit_votes([str(k) for k in range(13)], rows, counts.astype(float))
    want = [not f and bool(v) for f, v in zip(failed, verdicts(m, np.array(votes)))]
    assert [got[k].kept for k in range(len(texts))] == want
    assert all(want[:200]) and not any(want[200:220]) and any(m.junk)


def test_nothing_to_fit(make_docs):
    docs = make_docs([(1, "x")]).where("false")
    assert quality.judge(docs).collect() == [] and quality.keep_good(docs).collect() == []
    assert quality.fit_votes(["a"], np.zeros((0, 1)), np.zeros(0)).prior == 0.9


def test_repeated_rows_are_judged_alike(make_docs, prose):
    docs = make_docs([(1, prose(1)), (1, prose(1)), (2, prose(2))])
    assert [r.kept for r in quality.judge(docs).collect()] == [True] * 3
