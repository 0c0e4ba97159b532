"""Language of a text by its words, and by ever shorter character n-grams for words that were not learned.

A known word scores the logarithm of its smoothed frequency in each language. Any other word is cut into 5-grams with
marked ends; if none of them is known, into 4-grams, and so on to single letters; the known ones' mean counts. A text's
score is the sum over all of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import held_out, hold

_WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Words that a worker keeps scores of, at most, and bytes of their scores; a full table is emptied.
CACHE, CACHE_BYTES = 200_000, 16 << 20


@dataclass(frozen=True)
class Params:
    """max_docs: learned documents per language, about; every key of theirs is kept. evidence_words: words that count in full
    towards a score's certainty."""

    max_docs: int = 500
    smooth: float = 0.5
    evidence_words: int = 12


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case; a number that is no decimal digit, such as a raised 2, is no letter."""
    words = _WORD.findall(text.lower())
    if text.isascii():
        return words
    return [x for w in words if (x := w if w.isalpha() else "".join(filter(str.isalpha, w)))]


def grams(word: str, order: int) -> list[str]:
    marked = f"^{word}$" if order > 1 else word
    return [marked[k : k + order] for k in range(len(marked) - order + 1)]


class Model:
    """langs in order; counts (keys by languages) of the keys of every order, 0 for words. A key's row of logs is its score.

    Its size is that of the learned sample: keys times languages."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[list[str], np.ndarray]], params: Params) -> None:
        self.langs, self.params = langs, params
        self.at: dict[int, dict[str, int]] = {}
        logs = [np.zeros((0, len(langs)))]
        n = 0
        for order, (keys, counts) in tables.items():
            self.at[order] = {key: n + k for k, key in enumerate(keys)}
            n += len(keys)
            logs.append(np.log((counts + params.smooth) / (counts.sum(0) + params.smooth * max(1, len(keys)))))
        self.logs = np.concatenate(logs)
        self.room = min(CACHE, max(1_000, CACHE_BYTES // (8 * max(1, len(langs)))))
        self.cache: dict[str, int] = {}
        self.cached: np.ndarray | None = None

    def word(self, word: str) -> np.ndarray:
        row = self.at[0].get(word)
        if row is not None:
            return self.logs[row]
        for order in ORDERS:
            known = self.at[order]
            hits = [k for g in grams(word, order) if (k := known.get(g)) is not None]
            if hits:
                return self.logs[hits].sum(0) / len(hits)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.langs:
            return "und", 0.0
        if self.cached is None:
            self.cached = np.zeros((min(self.room, CACHE), len(self.langs)))
        cache, cached = self.cache, self.cached
        total, rows = np.zeros(len(self.langs)), []
        for w in words:
            k = cache.get(w)
            if k is None:
                if len(w) > 40:
                    total += self.word(w)
                    continue
                if len(cache) >= len(cached):
                    total += cached[rows].sum(0)
                    rows = []
                    cache.clear()
                k = cache[w] = len(cache)
                cached[k] = self.word(w)
            rows.append(k)
        if rows:
            total += cached[rows].sum(0)
        total = np.round(total, 9)
        sharp = (total - total.max()) / len(words) * min(len(words), self.params.evidence_words)
        return self.langs[int(np.argmax(total))], float(1 / np.exp(sharp).sum())


def learn(docs: DataFrame, params: Params = Params(), lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """The tables of the given documents; rows whose lang or text is null are left out.

    Of a language with over max_docs documents, those whose hash (of id and text) falls below max_docs / its number are
    learned. All of their words and n-grams reach the driver, so the sample bounds that.
    """
    usable = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    number = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(number)
    at = {lang: k for k, lang in enumerate(langs)}
    if not langs:
        return Model([], {k: ([], np.zeros((0, 0))) for k in (0, *ORDERS)}, params)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, params.max_docs / number[lang]))])
    spread = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # a bounded sample, dealt out anew as it may come from few parts of the table
    picked = usable.where(spread < share[F.col("lang")]).select("lang", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = at[lang]
                for w, n in Counter(words_of(text)).items():
                    seen[0, w, k] += n
                    for order in ORDERS:
                        for g in grams(w, order):
                            seen[order, g, k] += n
            if len(seen) > 500_000:
                yield out(seen)
                seen = Counter()
        yield out(seen)

    def out(seen):
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["o", "key", "lang", "n"])

    by = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"l{k}") for k in range(len(langs))]
    total = picked.mapInArrow(run, "o int, key string, lang int, n long").groupBy("o", "key").agg(*by).toArrow().sort_by([("o", "ascending"), ("key", "ascending")])
    orders = total.column("o").to_numpy()
    counts = np.array([total.column(f"l{k}").to_numpy() for k in range(len(langs))], float).T.reshape(len(total), len(langs))
    keys = total.column("key").to_pylist()
    tables = {}
    for order in (0, *ORDERS):
        a, b = np.searchsorted(orders, [order, order + 1])
        tables[order] = (keys[a:b], counts[a:b])
    return Model(langs, tables, params)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, lang_pred and score. No letter, a null text or an empty model: und, score 0.

    Repeated rows are predicted alike, an empty table gives no rows, whole texts count however long they are, a tie goes to
    the language that comes first, and other columns don't matter, whatever their names.
    """
    take = hold(docs.sparkSession, model)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        m = take()
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["id", "lang_pred", "score"])

    out = source.mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id"), 5, 0).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Learn from the documents that are not held out, then predict every document; see learn() and predict()."""
    return predict(docs, learn(docs.where(~held_out(F.col("doc_id"), 5, 0)), params))
