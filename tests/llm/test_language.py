import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitloom.llm import language

SYLLABLES = {"aa": "ka ro mi tu se".split(), "bb": "strong schlei pfer ung keit".split(), "cc": "eau çon ière ment quoi".split()}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(30))
        rows.append((k, text, lang, "s", len(text)))
    rows += [(1000, None, "aa", "s", 0), (1001, "", None, "s", 0), (1002, "123 !? ²", "bb", "s", 0), (1003, "日本語 文", None, "s", 0), (1004, "karo KARO mitu", None, None, None), (None, "karo mitu", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_documents(docs):
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items() if k is not None)
    assert all(rows[k].lang_pred == truth[k] for k in range(400))
    assert [rows[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and rows[1000].score == 0
    assert rows[1003].lang_pred in SYLLABLES and rows[1004].lang_pred == rows[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_unseen_words_back_off(docs):
    model = language.learn(docs)
    assert "keitungpferkeitungstrong" not in model.at[0]
    assert model.predict("keitungpferkeitungstrong")[0] == "bb"


def test_held_out_texts_are_not_learned(spark, docs):
    turned = spark.createDataFrame([(r.doc_id, "zzzz yyyy xxxx" if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.text, r.lang, r.source, r.n_chars) for r in docs.collect()], docs.schema)
    a = {r.doc_id: r.score for r in language.identify(docs).collect() if not r.held_out}
    assert a == {r.doc_id: r.score for r in language.identify(turned).collect() if not r.held_out}


def test_full_tables_change_nothing(docs, monkeypatch):
    model = language.learn(docs)
    texts = [r.text for r in docs.collect()]
    want = [model.predict(t) for t in texts]
    again = language.learn(docs)
    monkeypatch.setattr(language, "CACHE", 4)
    assert [(x, round(s, 9)) for x, s in map(again.predict, texts)] == [(x, round(s, 9)) for x, s in want]


def test_the_query_is_what_plain_counts_give(spark, docs):
    """Every document against tables and scores written out; with repeated rows, a very long text and clashing columns."""
    long = " ".join(r.text for r in docs.collect()[:60] if r.text) * 40
    more = spark.createDataFrame([(1, "karo", "aa", "s", 1), (5, None, "bb", "s", 1), (2000, long, None, "s", 1), (2001, "keitkeitx zzzq", "bb", "s", 1), (2001, "keitkeitx zzzq", "bb", "s", 1)], docs.schema)
    every = docs.unionByName(more).repartition(6)
    got = language.identify(every.withColumn("id", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("x.y", F.lit(1)), language.Params(evidence_words=4)).collect()

    rows = [tuple(r)[:3] for r in every.collect()]
    words = lambda t: [x for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if (x := "".join(c for c in w if c.isalpha()))]
    cut = lambda w, n: [m[k : k + n] for m in ["^" + w + "$" if n > 1 else w] for k in range(len(m) - n + 1)]
    counts = {n: {} for n in range(6)}
    langs = sorted({lang for i, t, lang in rows if lang and t is not None and zlib.crc32(str("" if i is None else i).encode()) % 5})
    for i, t, lang in rows:
        if lang and t is not None and zlib.crc32(str("" if i is None else i).encode()) % 5:
            for w in words(t):
                for n in range(6):
                    for key in cut(w, n) if n else [w]:
                        counts[n].setdefault(key, Counter())[lang] += 1
    whole = {n: {x: sum(c[x] for c in counts[n].values()) for x in langs} for n in range(6)}
    log = lambda n, key, x: math.log((counts[n][key][x] + 0.5) / (whole[n][x] + 0.5 * max(1, len(counts[n]))))

    def score(w):
        for n in (0, 5, 4, 3, 2, 1):
            known = [key for key in (cut(w, n) if n else [w]) if key in counts[n]]
            if known:
                return [sum(log(n, key, x) for key in known) / len(known) for x in langs]
        return [0.0] * len(langs)

    want = []
    for i, t, _ in rows:
        each = [score(w) for w in words(t)]
        if not each:
            want.append((i, "und", 0.0))
            continue
        total = [sum(s) for s in zip(*each)]
        sharp = [math.exp((x - max(total)) / len(each) * min(len(each), 4)) for x in total]
        want.append((i, langs[total.index(max(total))], 1 / sum(sharp)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 6))
    assert [key(r) for r in sorted(((r.doc_id, r.lang_pred, r.score) for r in got), key=key)] == [key(r) for r in sorted(want, key=key)]


def test_nothing_to_learn(docs):
    assert {r.lang_pred for r in language.predict(docs, language.learn(docs.where("false"))).collect()} == {"und"}
    assert language.identify(docs.where("false")).collect() == []
