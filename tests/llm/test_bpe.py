import hashlib
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.llm import bpe, queries

pytestmark = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/word_bpe_49k.json"), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    with open(path, encoding="utf-8") as f:
        return bpe.Encoder(f.read()), Tokenizer.from_file(path)


def same(both, text):
    ours, theirs = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids
    decoded = theirs.decode(ids, skip_special_tokens=False)
    assert ours.decode(ids) == decoded
    assert ours.digest(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", " ", "hello world's <|endoftext|> THE", "a" * 23, "aaaa aaaaa", "!!!???", "İstanbul ΣΑΣ ςας 日本語", "éa\x1cb \x85c", "1234²½", "'S 'll've <|startoftext|><|endoftext|>x", "​ x �", "x" * 5000, "</w> a</w>b", "ǆ Ǆ ŉ", "é Å", "ÿĀ"])
def test_texts(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    same(both, text)


def test_words_of_few_letters(both):
    rng = random.Random(1)
    for letters in ("ab ", "!?.- ", "aeinrst lo'", "hao"):
        for _ in range(300):
            same(both, "".join(rng.choice(letters) for _ in range(40)))


def test_full_tables_change_nothing(both, monkeypatch, prose):
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "ARCS", 5)
    monkeypatch.setattr(bpe, "PIECE", 10)
    same(both, prose(1) + " <|endoftext|> " + prose(2))


def test_gadgets_of_a_small_vocabulary_match_merging_in_order():
    rng = random.Random(5)
    for _ in range(60):
        vocab = {c: k for k, c in enumerate("abc")}
        merges = []
        while len(merges) < 12:
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u + v not in vocab and len(u + v) < 9:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
        a = bpe.Automaton(vocab, merges, suffix="")
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            want = list(word)
            for u, v in merges:
                k = 0
                while k < len(want) - 1:
                    if want[k] == u and want[k + 1] == v:
                        want[k : k + 2] = [u + v]
                    k += 1
            assert [a.labels[t] for t in a.path(word)] == want, (merges, word)


def test_query_rows(both, make_docs):
    docs = make_docs([None, "", "Hello you", "Hello you"])
    rows = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, queries.vocabulary()).collect())
    assert rows == [(k, *both[0].digest(t or "")) for k, t in enumerate([None, "", "Hello you", "Hello you"])]
    ids = bpe.tokens(docs.withColumnRenamed("lang", "Token_ids"), queries.vocabulary())
    assert {r.doc_id: r.token_ids for r in ids.collect()}[2] == both[0].encode("Hello you")
    assert bpe.digests(docs.where("false"), queries.vocabulary()).collect() == []


def test_every_word_of_the_test_tables_and_one_transition_a_byte(spark, both):
    """The query over whole tables against the library."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = both[1].encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = queries.queries()["op6_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_labels_come_out_as_soon_as_they_are_sure():
    a = bpe.Automaton({"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, [("a", "b"), ("ab", "c")], suffix="")
    state, out = a.start, []
    for letter in "aabab":
        state, labels = state.get(letter) or a.arc(state, letter)
        out.append(labels)
    # the first a is sure once a second follows; ab may still become abc
    assert out == [(), (0,), (), (3,), ()] and state.rest == (3,)
    assert a.path("aababc") == [0, 3, 4] and a.path("ax") == [] and a.path("axa") == []
    assert all(len(letter) == 1 for s in a.states.values() for letter in s)


def test_an_added_token_with_a_flag_is_refused():
    import json

    with open(queries.vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="flag"):
        bpe.Encoder(json.dumps(spec))
