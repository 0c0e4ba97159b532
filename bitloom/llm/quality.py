"""Quality rules by weak supervision.

Each rule looks at a document's signals and votes good (1), bad (-1) or abstains (0). Expectation-maximisation over all
documents estimates, without labels, kinds of documents and how often each rule accuses each kind: junk differs, and
what one rule sees another does not. How many kinds there are is decided by the Bayesian information criterion. A kind
is junk if several rules agree on accusing it, so a single rule's accusations count for as much as other rules bear them
out, and the posterior probability of the other kinds decides, in place of demanding that every rule passes. Votes are a
sufficient statistic: documents are counted by vote pattern (3^rules patterns at most, whatever the corpus size), and
the fit runs on those counts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bitloom.llm.common import cut, free_name, word_chunks

SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_exclaim", "n_enders", "n_bare", "n_stutter", "n_marked"]
_ENDER = re.compile(rb"[.!?][\x20\x09-\x0D]")
_WINDOW = 8
_MARKED = re.compile(rb"[#*$%&|<>]{2}[^\x20\x09-\x0D]*")
#: Kinds of junk that are tried at most, and the accusations that a kind must draw above the best one's to be junk.
KINDS, AGREE = 6, 1.5


def repeated_words(ids: np.ndarray, window: int = _WINDOW) -> int:
    """Words inside runs of `window` words that occur twice or more; window is a power of two. Exact: ranks double."""
    n = len(ids)
    if n <= window:
        return 0
    rank, width = ids.astype(np.int64), 1
    while width < window:
        rank = rank[:-width] * n + rank[width:]
        _, rank, counts = np.unique(rank, return_inverse=True, return_counts=True)
        if counts.max() < 2:
            return 0
        width *= 2
    starts = np.nonzero(counts[rank] > 1)[0]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def signals_of(text: str | None) -> tuple[int, ...]:
    """The numbers named in SIGNALS, of one whole text; null counts as empty."""
    if not text:
        return (0,) * len(SIGNALS)
    data = text.encode()
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for words in word_chunks(data) for w in words]
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    blank = len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c"))
    letters = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    wide = "" if text.isascii() else "".join(c for c in text if c > "\x7f")
    bare = sum(1 for w in known if not re.search(rb"[A-Za-z0-9\x80-\xff]", w)) if re.search(rb"(?<![^\x20\x09-\x0D])[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+(?![^\x20\x09-\x0D])", data) else 0
    if bare:
        none = {k for w, k in known.items() if not re.search(rb"[A-Za-z0-9\x80-\xff]", w)}
        bare = sum(1 for k in ids if k in none)
    places = np.array(ids, np.int64)
    return (
        len(ids),
        len(text) - blank,
        len(data) - len(data.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(places),
        len(lines),
        len(known),
        upper + sum(map(str.isupper, wide)),
        letters + sum(map(str.isalpha, wide)),
        data.count(b"!"),
        len(_ENDER.findall(data + b" ")),
        bare,
        int((places[1:] == places[:-1]).sum()),
        len(_MARKED.findall(data)),
    )


def signals(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """docs with the SIGNALS columns (long), renamed where docs has such names; and the names by signal."""
    kept = [c for c in docs.columns if not (drop_text and c == text_col)]
    names, frame = {}, docs
    for s in SIGNALS:
        names[s] = free_name(frame, s)
    at, held = docs.columns.index(text_col), [docs.columns.index(c) for c in kept]
    out = StructType([docs.schema.fields[i] for i in held] + [StructField(n, LongType(), False) for n in names.values()])
    fields = [*kept, *names.values()]

    def run(batches):
        for batch in batches:
            found = np.array([signals_of(t.as_py()) for t in batch.column(at)], np.int64).reshape(-1, len(SIGNALS))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in held), *(pa.array(found[:, k]) for k in range(len(SIGNALS)))], names=fields)

    return docs.mapInArrow(run, out), names


def base_failed(n: dict[str, str]) -> Column:
    return (F.col(n["n_words"]) < 20) | (F.col(n["n_repeat_words"]) * 100 > F.col(n["n_words"]) * 30)


def rules(n: dict[str, str]) -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. Shares are of words, lines or letters; an empty whole abstains."""
    c = {k: F.col(v) for k, v in n.items()}
    words = F.when(c["n_words"] > 0, c["n_words"])
    letters = F.when(c["n_letters"] > 0, c["n_letters"])
    lines = F.when(c["n_lines"] > 1, c["n_lines"])

    def vote(x: Column, bad: Column, good: Column) -> Column:
        return F.when(x.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)

    share = c["n_symbols"] / words
    repeat = c["n_repeat_words"] / words
    dup = c["n_dup_lines"] / lines
    upper = c["n_upper"] / letters
    loud = c["n_exclaim"] / words
    mean = c["word_chars"] / words
    fresh = c["n_distinct"] / F.sqrt(words)
    ends = c["n_enders"] / words
    bare = c["n_bare"] / words
    stutter = c["n_stutter"] / words
    plain = c["n_letters"] / F.when(c["word_chars"] > 0, c["word_chars"])
    marked = c["n_marked"] / words
    return {
        "symbols": vote(share, share > 0.1, share < 0.02),
        "repeats": vote(repeat, repeat > 0.3, (repeat < 0.05) & (words >= 16)),
        "lines": vote(dup, dup > 0.3, dup < 0.1),
        "capitals": vote(upper, upper > 0.5, upper < 0.2),
        "shouting": vote(loud, loud > 0.25, loud < 0.05),
        "word_length": vote(mean, (mean < 2.2) | (mean > 16), (mean >= 3) & (mean <= 12)),
        "variety": vote(fresh, fresh < 1.5, (fresh > 2.5) & (words >= 20)),
        "sentences": vote(ends, (ends == 0) & (words >= 60), (ends > 0.01) & (ends < 0.5)),
        "bare_marks": vote(bare, bare > 0.2, bare < 0.05),
        "stutter": vote(stutter, stutter > 0.2, (stutter < 0.05) & (words >= 10)),
        "length": vote(words, words < 5, words >= 30),
        "letters": vote(plain, plain < 0.75, plain > 0.85),
        "marked_words": vote(marked, marked > 0.1, marked < 0.02),
    }


@dataclass(frozen=True)
class VoteModel:
    """By kind: its share of the documents, whether it is junk, and per rule the probability that a vote is "bad"."""

    names: tuple[str, ...]
    shares: tuple[float, ...]
    junk: tuple[bool, ...]
    rates: tuple[tuple[float, ...], ...]

    @property
    def prior(self) -> float:
        """The share of good documents."""
        return sum(s for s, bad in zip(self.shares, self.junk) if not bad)

    def _weight(self, votes: dict[str, Column], junk: bool) -> Column:
        """The probability of the votes and of being of a kind that is, or isn't, junk."""
        total = F.lit(0.0)
        for share, bad, rates in zip(self.shares, self.junk, self.rates):
            if bad == junk:
                log = F.lit(math.log(share))
                for name, r in zip(self.names, rates):
                    log = log + F.when(votes[name] == -1, math.log(r)).when(votes[name] == 1, math.log1p(-r)).otherwise(0.0)
                total = total + F.exp(log)
        return total

    def posterior(self, votes: dict[str, Column]) -> Column:
        good = self._weight(votes, False)
        return good / (good + self._weight(votes, True))


def _start(down: np.ndarray, counts: np.ndarray, kinds: int) -> np.ndarray:
    """First guesses of each pattern's kind, the last `kinds` of them by seeds: in turn the commonest pattern of two
    accusations or more that shares less than half of them with an earlier seed. Nearness is by shared accusations."""
    n, free = down.sum(1), down.sum(1) >= 2
    near = np.zeros((len(down), kinds))
    for k in range(kinds):
        weight = np.where(free, counts, 0)
        if not weight.any():
            break
        seed = down[int(np.argmax(weight))]
        both = (down & seed).sum(1)
        near[:, k] = both / np.maximum(n + seed.sum() - both, 1)
        free &= near[:, k] < 0.5
    junk = np.where(n >= 2, 0.9, np.where(n == 1, 0.3, 0.01))
    total = near.sum(1)
    split = np.where(total[:, None] > 0, near / np.where(total > 0, total, 1)[:, None], 1 / max(1, kinds))
    return np.hstack([1 - junk[:, None], junk[:, None] * split]) if kinds else np.ones((len(down), 1))


def _maximise(down: np.ndarray, up: np.ndarray, counts: np.ndarray, kinds: int, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(shares, rates, log likelihood) of a good kind and `kinds` others. Counts get half a vote either way, so that no
    probability is 0 or 1."""
    p, last = _start(down, counts, kinds), -np.inf
    for _ in range(rounds):
        w = counts[:, None] * p
        shares = (w.sum(0) + 0.5) / (counts.sum() + 0.5 * (kinds + 1))
        rates = np.clip((w.T @ down + 0.5) / (w.T @ (down | up) + 1), 1e-9, 1 - 1e-9)
        log = np.log(shares) + down @ np.log(rates).T + up @ np.log1p(-rates).T
        each = np.logaddexp.reduce(log, axis=1)
        like = float(counts @ each)
        p = np.exp(log - each[:, None])
        if like - last <= tol * max(1.0, abs(like)):
            break
        last = like
    return shares, rates, like


def fit_votes(names: list[str], patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tol: float = 1e-9) -> VoteModel:
    """Expectation-maximisation on distinct vote patterns (rows of -1, 0, 1) and their counts.

    Abstaining says nothing. Zero to KINDS further kinds beside the first are tried, and the criterion takes the number.
    The kind that draws the fewest accusations is good; others are junk if they draw AGREE more than it, summed over the
    rules, so by one rule's word alone no kind is. No patterns: nine in ten are held to be good.
    """
    if not len(counts):
        return VoteModel(tuple(names), (0.9, 0.1), (False, True), ((0.5,) * len(names),) * 2)
    down, up = patterns == -1, patterns == 1
    best = None
    for kinds in range(KINDS + 1):
        shares, rates, like = _maximise(down, up, counts, kinds, rounds, tol)
        worth = like - 0.5 * kinds * (len(names) + 1) * np.log(counts.sum())
        if best is None or worth > best[0]:
            best = worth, shares, rates
    _, shares, rates = best
    voted = (counts @ (down | up)) > 0
    least = rates[int(np.argmin(rates[:, voted].sum(1)))]
    junk = np.maximum(rates - least, 0)[:, voted].sum(1) >= AGREE
    return VoteModel(tuple(names), tuple(map(float, shares)), tuple(map(bool, junk)), tuple(tuple(map(float, r)) for r in rates))


def voted(frame: DataFrame, names: dict[str, str]) -> tuple[DataFrame, dict[str, Column]]:
    """frame with a column of votes by rule, and those columns by the rules' names."""
    said = rules(names)
    at = {rule: free_name(frame, f"vote_{rule}") for rule in said}
    return frame.select("*", *[v.cast("int").alias(at[rule]) for rule, v in said.items()]), {rule: F.col(c) for rule, c in at.items()}


def fit(frame: DataFrame, votes: dict[str, Column]) -> VoteModel:
    """The vote model of all rows of a frame. What reaches the driver is bounded by 3^13 patterns."""
    found = frame.groupBy(*votes.values()).count().collect()
    rows = np.array([tuple(r) for r in found], np.int64).reshape(-1, len(votes) + 1)
    order = np.lexsort(rows.T)
    return fit_votes(list(votes), rows[order, :-1], rows[order, -1].astype(float))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row of docs: id, the signals, the votes, base_failed, posterior and kept. The fit is to what passes the base.

    Null and empty texts have no words: base_failed, not kept. Repeated rows are judged alike; an empty table gives none.
    """
    frame, names = signals(docs.select(id_col, text_col), text_col, drop_text=True)
    frame, votes = voted(frame.withColumn("base_failed", base_failed(names)), names)
    frame = cut(frame)
    model = fit(frame.where("not base_failed"), votes)
    return frame.withColumn("posterior", model.posterior(votes)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows that judge() does not keep; the model is fitted on these docs. Columns stay as they are,
    whatever their names. Texts are read for signals once: what passes the base is written with its votes, then filtered."""
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    frame, names = signals(numbered, f"c{docs.columns.index(text_col)}")
    frame, votes = voted(frame.where(~base_failed(names)), names)
    frame = cut(frame.drop(*names.values()))
    return frame.where(fit(frame, votes).posterior(votes) >= threshold).select(*numbered.columns).toDF(*docs.columns)
