"""Toxicity from the nearest labelled examples.

Examples are a bounded sample of labelled documents, clean ones too, as TF-IDF vectors over all of their words. Document
frequencies come from all documents. A term whose presence goes with label 1 beyond chance, among a larger bounded
sample, weighs more by its log odds, and for such terms beginnings of words count too; every other word keeps a floor.
The examples' vectors lie in an inverted index: each term's postings are cut into blocks of examples, each with its
greatest weight. A document's blocks are taken by falling upper bound, and what can't reach the k-th best is left, so
its nearest examples by cosine are exact. Votes weigh by squared cosine; the mapping from votes to probability is an
isotonic fit to the examples' own leave-one-out votes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import cut, drop, held_out, hold

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Params:
    """max_fit, max_examples: labelled rows used, per class, to weigh terms and as examples. heads: lengths of beginnings.

    A term is told from chance by the signed root of its G statistic, which must reach min_root. floor: weight of the
    other words against a log odds of one. first: blocks that a document looks into before it bounds the rest.
    """

    max_fit: int = 10_000
    max_examples: int = 500
    min_root: float = 4.0
    heads: tuple[int, ...] = (4, 5, 6, 7)
    floor: float = 0.1
    k: int = 15
    doubt: float = 0.05
    block: int = 64
    first: int = 4
    threshold: float = 0.7


def counts_of(text: str) -> Counter:
    """The words of a whole text in lower case, and how often each is there."""
    return Counter(_WORD.findall(text.lower()))


def heads_of(words: Counter, lengths: tuple[int, ...], known=None) -> Counter:
    """The beginnings, marked ^, of longer words; of known ones only, if known is given."""
    out: Counter = Counter()
    for w, n in words.items():
        for k in lengths:
            if len(w) <= k:
                break
            h = "^" + w[:k]
            if known is None or h in known:
                out[h] += n
    return out


class Vocabulary:
    """Numbers of terms."""

    def __init__(self, terms: list[str], lengths: tuple[int, ...]) -> None:
        self.number, self.lengths = {t: k for k, t in enumerate(terms)}, lengths
        self.least = min(lengths, default=0)
        self.starts = frozenset(t[1 : self.least + 1] for t in terms if t[0] == "^")

    def numbers(self, words: Counter) -> tuple[list[int], list[int], float]:
        """(numbers, counts) of a text's terms, beginnings once, and the squared weights of its words without a number."""
        at, counts, spare, heads = [], [], [], {}
        number, starts, least = self.number.get, self.starts, self.least
        for w, n in words.items():
            k = number(w)
            if k is None:
                spare.append(n)
            else:
                at.append(k)
                counts.append(n)
            if w[:least] in starts:
                for size in self.lengths:
                    if size < len(w) and (h := number("^" + w[:size])) is not None:
                        heads[h] = heads.get(h, 0) + n
        return [*at, *heads], [*counts, *heads.values()], float(sum((1 + math.log(n)) ** 2 for n in spare))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, owner) of all numbers in the ranges."""
    size = ends - starts
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) + np.repeat(starts - np.cumsum(size) + size, size), owner


class BlockMaxIndex:
    """Unit vectors, sparse and without negative weights, as posting lists by term. A list is cut where its rows pass from
    one block of rows to the next, and each such piece has its greatest weight; a list that holds many of the rows is
    written out over all of them. For exact top-k by inner product."""

    #: A list is written out if it holds at least this part of the rows.
    WRITTEN_OUT = 1 / 8

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int, order: list[int] | None = None, first: int = 4) -> None:
        """vectors: (terms, weights) of every row; order: rows in the order in which they fill blocks; first: blocks that are
        looked into before the rest are bounded."""
        n = len(vectors)
        self.first, self.rows = first, n
        self.order = np.array(order if order is not None else range(n), np.int64)
        place = np.argsort(self.order)
        term = np.concatenate([t for t, _ in vectors]) if n else np.zeros(0, np.int64)
        row = np.repeat(place, [len(t) for t, _ in vectors]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if n else np.zeros(0)
        size = np.bincount(term, minlength=terms)
        long = np.nonzero(size >= max(2, n * self.WRITTEN_OUT))[0]
        self.out = np.full(terms, -1)
        self.out[long] = np.arange(len(long))
        self.full = np.zeros((len(long), n))
        whole = self.out[term] >= 0
        self.full[self.out[term[whole]], row[whole]] = weight[whole]
        term, row, weight = term[~whole], row[~whole], weight[~whole]
        at = np.lexsort((row, term))
        term, self.row, self.weight = term[at], row[at], weight[at]
        cell = self.row // block
        self.starts = np.arange(0, n, block)
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (cell[1:] != cell[:-1])
        self.piece = np.append(np.nonzero(new)[0], len(term))
        self.piece_block = cell[new]
        self.piece_most = np.maximum.reduceat(self.weight, self.piece[:-1]) if len(term) else np.zeros(0)
        self.list = np.searchsorted(term[new], np.arange(terms + 1))

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k best with a positive product, ties to the smaller row; skip is left out."""
        out = self.out[terms]
        score = weights[out >= 0] @ self.full[out[out >= 0]]
        terms, weights = terms[out < 0], weights[out < 0]
        pieces, owner = _ranges(self.list[terms], self.list[terms + 1])
        of_piece, block = weights[owner], self.piece_block[pieces]
        # a block's best row can't pass its best so far plus the greatest weights of the pieces in it
        bounds = np.maximum.reduceat(score, self.starts) + np.bincount(block, of_piece * self.piece_most[pieces], len(self.starts))
        taken = np.zeros(len(bounds), bool)
        taken[np.argsort(-bounds, kind="stable")[: self.first]] = True
        score = score + self._products(pieces, of_piece, taken[block])
        wanted = k + (skip >= 0)
        least = float(np.partition(score, -wanted)[-wanted]) if len(score) >= wanted else 0.0
        rest = (bounds >= least - 1e-9) & ~taken
        if rest.any():
            score += self._products(pieces, of_piece, rest[block])
        score = np.round(score, 12)
        hit = np.nonzero(score >= max(np.round(least - 1e-9, 12), 1e-12))[0]
        rows = self.order[hit]
        if skip >= 0:
            hit, rows = hit[rows != skip], rows[rows != skip]
        found = score[hit]
        best = np.lexsort((rows, -found))[:k]
        return rows[best], found[best]

    def _products(self, pieces: np.ndarray, weights: np.ndarray, use: np.ndarray) -> np.ndarray:
        at, owner = _ranges(self.piece[pieces[use]], self.piece[pieces[use] + 1])
        return np.bincount(self.row[at], weights[use][owner] * self.weight[at], self.rows)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing step fit of y on x with weights w: pool adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, least x, greatest x
    for k in order:
        pools.append([float(y[k]), float(w[k]), float(x[k]), float(x[k])])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            m, v, _, hi = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + m * v) / (last[1] + v)
            last[1], last[3] = last[1] + v, hi
    return np.array([v for p in pools for v in p[2:]]), np.array([p[0] for p in pools for _ in (0, 1)])


@dataclass
class Model:
    """weight: of every term of an example, its idf times its log odds or the floor; apart: the largest weight, which words
    that no example has get in a text's length."""

    params: Params
    weight: np.ndarray
    apart: float
    ids: list
    toxic: np.ndarray
    votes: np.ndarray
    base: float
    index: BlockMaxIndex | None = None
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def vector(self, at: np.ndarray, counts: np.ndarray, spare: float) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of what Vocabulary.numbers() gives, of length 1 with the words that no example has."""
        w = (1 + np.log(counts)) * self.weight[at]
        length = np.sqrt(w @ w + spare * self.apart**2)
        return (at, w / length) if length > 0 else (at[:0], w[:0])

    def raw(self, at: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[float | None, np.ndarray, np.ndarray]:
        """The weighted share of toxic votes, None without a neighbour; the neighbours and their cosines.

        A vote of weight `doubt` for label 0 is always cast, so that far neighbours alone convince nobody.
        """
        if not len(at) or not len(self.toxic):
            return None, at[:0], w[:0]
        ids, sims = self.index.top(at, w, self.params.k, skip)
        if not len(ids):
            return None, ids, sims
        v = sims**2 * self.votes[ids]
        return float((v * self.toxic[ids]).sum() / (v.sum() + self.params.doubt)), ids, sims

    def score(self, at: np.ndarray, counts: np.ndarray, spare: float) -> tuple[float, str]:
        """The probability of label 1, and as evidence the nearest examples as id:label:cosine."""
        raw, ids, sims = self.raw(*self.vector(at, counts, spare))
        if raw is None:
            return self.base, ""
        p = float(np.clip(np.interp(raw, *self.curve), 0, 1)) if self.curve else raw
        return p, ",".join(f"{self.ids[i]}:{self.toxic[i]}:{s:.3f}" for i, s in zip(ids[:3], sims[:3]))


def build(examples: list[tuple], terms: Vocabulary, frequencies: np.ndarray, n: int, odds: dict[str, float], amount: dict[int, int], p: Params) -> Model:
    """The model of labelled examples (id, words, label). frequencies: documents of n that hold each of the terms; odds: log
    odds of those that go with label 1; amount: labelled rows by label, which the votes are weighed up to."""
    idf = np.maximum(np.log((n + 1) / (frequencies + 1)), 0)
    weight = idf * np.array([odds.get(t, p.floor) for t in terms.number])
    each = Counter(t for _, _, t in examples)
    share = {t: amount.get(t, 0) / each[t] for t in each}
    mass = sum(share[t] * each[t] for t in each)
    toxic = np.array([t for _, _, t in examples], np.int64)
    model = Model(p, weight, float(np.log(n + 1) * p.floor), [i for i, _, _ in examples], toxic, np.array([share[t] / share.get(1, 1.0) for t in toxic]), share.get(1, 0.0) * each[1] / mass if mass else 0.0)
    vectors = []
    for _, words, _ in examples:
        at, counts, spare = terms.numbers(words)
        vectors.append(model.vector(np.array(at, np.int64), np.array(counts, float), spare))
    lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
    model.index = BlockMaxIndex(vectors, len(weight), p.block, sorted(range(len(vectors)), key=lambda k: (toxic[k], lead[k], k)), p.first)
    votes = [(model.raw(*v, skip=k)[0], k) for k, v in enumerate(vectors)]
    seen = [(raw, toxic[k], share[toxic[k]]) for raw, k in votes if raw is not None]
    if seen:
        model.curve = isotonic(*(np.array(x, float) for x in zip(*seen)))
    return model


def _sample(labels: DataFrame, n: int) -> list[tuple]:
    """Up to n labelled rows of each class, by the hash of their ids."""
    rows = []
    for toxic in (0, 1):
        rows += labels.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "toxic").collect()
    return [tuple(r) for r in rows]


def _texts(docs: DataFrame, rows: list[tuple], kind: str) -> DataFrame:
    """(id, label, text) of the labelled rows; of several documents of one id the least text."""
    wanted = F.broadcast(docs.sparkSession.createDataFrame(rows, f"want {kind}, label int"))
    return docs.join(wanted, F.col("id") == F.col("want")).groupBy("id", "label").agg(F.min("text").alias("text"))


def term_odds(sampled: DataFrame, p: Params) -> dict[str, float]:
    """The log odds of the terms, beginnings too, whose presence goes with label 1 beyond chance among the sampled rows;
    each count a half up. sampled: label and text; its bounded number of rows bounds what reaches the driver."""
    lengths = p.heads

    def run(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = counts_of(text or "")
                for term in (*words, *heads_of(words, lengths)):
                    seen.setdefault(term, [0, 0])[label] += 1
            if len(seen) > 300_000:
                yield out(seen)
                seen = {}
        yield out(seen)

    def out(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], names=["term", "n0", "n1"])

    sizes = {r[0]: r[1] for r in sampled.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return {}
    total = sampled.select("label", "text").mapInArrow(run, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
    c0, c1 = F.col("c0"), F.col("c1")
    part = lambda c, n: F.when(c > 0, c * F.log(c / ((c0 + c1) * (n / (n0 + n1))))).otherwise(0.0)
    g = 2 * (part(c0, n0) + part(c1, n1))
    kept = total.where((c1 * n0 > c0 * n1) & (g >= p.min_root**2))
    return {r.term: float(np.log((r.c1 + 0.5) / (n1 + 1)) - np.log((r.c0 + 0.5) / (n0 + 1))) for r in kept.collect()}


def numbered(docs: DataFrame, terms: Vocabulary) -> DataFrame:
    """id, and of every whole text what Vocabulary.numbers() gives: terms, counts, spare. docs: id and text."""
    take = hold(docs.sparkSession, terms)

    def run(batches):
        known = take()
        for batch in batches:
            found = [known.numbers(counts_of(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _, _ in found], pa.list_(pa.int32())), pa.array([c for _, c, _ in found], pa.list_(pa.int32())), pa.array([x for _, _, x in found], pa.float64())], names=["id", "terms", "counts", "spare"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, terms array<int>, counts array<int>, spare double")


def learn(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[Model, DataFrame]:
    """The model of documents (id, text) by the labels that aren't held out; and the documents by numbers of its terms."""
    kind = docs.schema["id"].dataType.simpleString()
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    usable = cut(usable.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic")))
    amount = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    rows = _sample(usable, p.max_fit)
    sampled = cut(_texts(docs, rows, kind))
    odds = term_odds(sampled, p)
    chosen, sizes = [], Counter()
    for i, label in rows:
        sizes[label] += 1
        if sizes[label] <= p.max_examples:
            chosen.append((i, label))
    lengths, heads = p.heads, frozenset(t for t in odds if t[0] == "^")

    def run(batches):
        for batch in batches:
            words = [counts_of(t or "") for t in batch.column(2).to_pylist()]
            words = [w | heads_of(w, lengths, heads) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(w) for w in words], pa.list_(pa.string())), pa.array([list(w.values()) for w in words], pa.list_(pa.int32()))], names=["id", "label", "terms", "counts"])

    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"want {kind}, of int").select("want"))
    found = sampled.join(wanted, F.col("id") == F.col("want"), "left_semi").mapInArrow(run, f"id {kind}, label int, terms array<string>, counts array<int>")
    examples = sorted((r.id, r.label, dict(zip(r.terms, r.counts))) for r in found.collect()) if chosen else []
    terms = sorted({t for _, _, words in examples for t in words})
    vocabulary = Vocabulary(terms, lengths)
    counted = cut(numbered(docs, vocabulary))
    frequencies, n = np.zeros(len(terms)), counted.count()
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        frequencies[r.t] = r["count"]
    drop(usable, sampled)
    bare = [(i, Counter({w: c for w, c in words.items() if w[0] != "^"}), label) for i, label, words in examples]
    return build(bare, vocabulary, frequencies, n, odds, amount, p), counted


def score(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, score, predicted and evidence.

    labels: doc_id and toxic; rows with another toxic than 0 or 1 or with a null id are not used, and of several of one id
    the smallest counts. Null and empty texts, and those that share no word with an example, get the rate of label 1
    among the usable labels. Without usable labels of both classes every score is the rate of label 1 (0 without any).
    Repeated documents each get the same score and an empty table gives no rows; other columns don't matter.
    """
    p = params
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    model, counted = learn(source, labels, p)
    take = hold(docs.sparkSession, model)
    threshold = p.threshold

    def run(batches):
        m = take()
        for batch in batches:
            ends = np.append(0, np.cumsum(batch.column(1).value_lengths().to_numpy()))
            terms, counts = (batch.column(k).flatten().to_numpy() for k in (1, 2))
            terms, counts, spare = terms.astype(np.int64), counts.astype(float), batch.column(3).to_numpy()
            found = [m.score(terms[a:b], counts[a:b], x) for a, b, x in zip(ends[:-1].tolist(), ends[1:].tolist(), spare.tolist())]
            s = [x for x, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array([e for _, e in found], pa.string())], names=["id", "score", "predicted", "evidence"])

    out = counted.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double, predicted int, evidence string")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id"), 3, 1).alias("held_out"), "score", "predicted", "evidence")
