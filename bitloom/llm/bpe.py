"""Byte-pair encoding by a deterministic automaton over bytes.

The construction starts as one state with a loop for every base symbol. Each merge (u, v) -> x, in order, is a gadget:
after u the arc v goes, x gets the state that v led to, and x can be taken wherever u could. The paths that are left
spell every text in exactly one way, the one that applying the merges gives. Written out, the arcs of a 49,000-token
vocabulary number about 2.4 thousand millions, as every state copies another. States and labels are therefore kept by
copy-on-write: whom each copied and when, and the arcs that went; follows() reads an arc through those tables.

That automaton reads tokens. Encoding reads bytes, by its determinisation: a state holds the tokens that may be under way
(the place in the trie of tokens, the token before it, and the labels not yet emitted), and an arc over a byte emits the
labels that all of them share, so a label comes out as soon as no later byte can change it. A word is encoded by one
transition a byte, looked up in a table, without choice or way back. The table fills as transitions are met and starts
anew when it is full; decoding is emitting the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the word table and of the transition table in a worker. A full transition table is emptied; a full word
#: table becomes the old one, from which words that are met again are taken over.
WORDS, ARCS = 50_000, 400_000
#: Words of more letters than this are not kept in the table.
LONG_WORD = 48
#: Characters of a text that are encoded at a time, up to the next space.
PIECE = 1 << 20
#: Bytes are held as the letters U+0000 to U+00FF, so that this is none of them.
_END = "Ā"
_FAR_FUTURE = 1 << 40


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, the rest from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class State(dict):
    """Arcs by letter, each (state, labels emitted), and the threads that the state stands for: (place in the trie, token
    before, labels held back), longest under way first; the one at the root, if any, is complete."""

    __slots__ = ("threads", "rest")

    def __init__(self, threads: tuple[tuple[int, int, tuple[int, ...]], ...]) -> None:
        super().__init__()
        self.threads = threads
        self.rest = next((held for place, _, held in threads if place == 0), None)


class Automaton:
    """The automaton of a vocabulary: token -> id, and merges in order. suffix marks a base symbol that ends a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "</w>") -> None:
        letters = _byte_letters()
        self.labels = {i: t for t, i in vocab.items()}
        spelled: dict[str, str] = {}
        for c, b in letters.items():
            if c in vocab:
                spelled[c] = chr(b)
            if suffix and c + suffix in vocab:
                spelled[c + suffix] = chr(b) + _END
        self.copied_state: dict[int, int] = {}
        self.copied_label: dict[int, int] = {}
        self.born = {vocab[t]: -1 for t in spelled}
        self.gone: dict[tuple[int, int], int] = {}
        idle: set[str] = set()
        for rank, (u, v) in enumerate(merges):
            x = u + v
            if (u not in spelled and u not in idle) or (v not in spelled and v not in idle) or x not in vocab:
                raise ValueError(f"merge {rank} is not of known symbols")
            # earlier merges may leave no path on which v follows u; then nothing is spelled by x
            if idle.isdisjoint((u, v)) and self.follows(vocab[u], vocab[v]):
                self._gadget(rank, vocab[u], vocab[v], vocab[x])
                spelled[x] = spelled[u] + spelled[v]
            else:
                idle.add(x)
        # the trie of all tokens: the next place by place and letter, and at every place the token that ends there, and
        # whether longer ones go on
        self.next: dict[int, int] = {}
        self.ends, self.goes_on = array("l", [-1]), bytearray(1)
        for t, letters in spelled.items():
            place = 0
            for c in letters:
                self.goes_on[place] = 1
                key = place << 9 | ord(c)
                if key not in self.next:
                    self.next[key] = len(self.ends)
                    self.ends.append(-1)
                    self.goes_on.append(0)
                place = self.next[key]
            self.ends[place] = vocab[t]
        self._empty()

    def _empty(self) -> None:
        """An empty transition table. One arc leads to the state without threads, from which none leads away."""
        self.start = State(((0, -1, ()),))
        self.states = {self.start.threads: self.start}
        self.n_arcs = 0

    def _gadget(self, rank: int, u: int, v: int, x: int) -> None:
        self.gone[u, v] = rank
        self.copied_state[x] = v
        self.copied_label[x] = u
        self.born[x] = rank

    def follows(self, state: int, label: int) -> bool:
        """Whether the state that label `state` leads to has an arc `label`."""
        born, gone, when = self.born, self.gone, _FAR_FUTURE
        while True:
            if gone.get((state, label), _FAR_FUTURE) < when:
                return False
            a, b = born[state], born[label]
            if a < 0 and b < 0:
                return True
            # A gadget copies the state before its own arc goes and the label after, so only arcs that went earlier
            # count for a copied state, and where both stem from one gadget the label is the later copy.
            if a > b:
                when, state = a, self.copied_state[state]
            elif b > a:
                when, label = b, self.copied_label[label]
                if gone.get((state, label)) == when:
                    # the arc that this very gadget took away
                    return False
            else:
                when, label = b, self.copied_label[label]

    def arc(self, state: State, letter: str) -> tuple[State, tuple[int, ...]]:
        """The transition of a state over a letter, which enters the table."""
        threads = []
        whole = None
        code = ord(letter)
        for place, last, held in state.threads:
            place = self.next.get(place << 9 | code)
            if place is not None:
                if self.goes_on[place]:
                    threads.append((place, last, held))
                t = self.ends[place]
                if t >= 0 and (last < 0 or self.follows(last, t)):
                    # every beginning of a word is spelled by one path at most, so there is one such thread at most
                    whole = (0, t, (*held, t))
        if whole:
            threads.append(whole)
        shared = 0
        if threads:
            first, rest = threads[0][2], [h for _, _, h in threads[1:]]
            while shared < len(first) and all(len(h) > shared and h[shared] == first[shared] for h in rest):
                shared += 1
        key = tuple((place, last, held[shared:]) for place, last, held in threads)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = State(key)
        self.n_arcs += 1
        out = state[letter] = (to, threads[0][2][:shared] if threads else ())
        return out

    def path(self, word: str) -> list[int]:
        """The labels along the one path that spells word (with its end mark); [] where a symbol is unknown."""
        if self.n_arcs >= ARCS:
            self._empty()
        state, out = self.start, []
        for letter in word:
            arc = state.get(letter) or self.arc(state, letter)
            state = arc[0]
            out += arc[1]
        if state.rest is None:
            return []
        return out + list(state.rest)


class Encoder:
    """What the tokenizers library makes of a text with such a file: added tokens, normaliser, word split, merges.

    Texts of characters up to U+024F, which normalise and split by rules known here, are split by a pattern; others by
    the library's own normaliser and splitter, so that its Unicode tables decide.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.automaton = Automaton(model["vocab"], merges, self.suffix)
        for a in spec["added_tokens"]:
            if a.get("single_word") or a.get("lstrip") or a.get("rstrip") or a.get("normalized"):
                raise ValueError(f"added token {a['content']!r} has a flag that isn't supported")
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        # only its normaliser and splitter are asked, so it goes without the vocabulary
        bare = {**spec, "added_tokens": [], "post_processor": None, "decoder": None, "truncation": None, "padding": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.library = Tokenizer.from_str(json.dumps(bare))
        self.back = {c: b for c, b in _byte_letters().items()}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.old_words: dict[str, tuple[int, str, str]] = {}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letters = "a-zªµºß-öø-ÿĀ-ɏ"
        digits = "0-9²³¹¼-¾"
        space = r"\t\n\x0b\x0c\r \x85\xa0"
        self.splitter = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+")
        self.odd = re.compile(r"[^\x00-įı-ɏ]")
        self.known_rules = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _SPLITTER

    def words_of(self, text: str) -> list[str]:
        """The words of text that has no added token; those of odd texts come back from the byte letters."""
        if self.known_rules and (text.isascii() or not self.odd.search(text)):
            return self.splitter.findall(text.lower())
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.back[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in parts]

    def word(self, word: str) -> tuple[int, str, str]:
        """(number of tokens, ids, labels) of a word, the last two joined by spaces."""
        entry = self.old_words.get(word)
        if entry is None:
            data = word if word.isascii() else word.encode("utf-8", "surrogateescape").decode("latin-1")
            ids = self.automaton.path(data + _END if self.suffix else data)
            labels = self.automaton.labels
            entry = (len(ids), " ".join(map(str, ids)), " ".join([labels[i] for i in ids]))
        if len(word) <= LONG_WORD:
            if len(self.words) >= WORDS:
                self.old_words, self.words = self.words, {}
            self.words[word] = entry
        return entry

    def entries(self, text: str) -> Iterator[list[tuple[int, str, str]]]:
        """The entries of a whole text, in lists of bounded size."""
        parts = self.split_added.split(text) if self.split_added else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [(1, str(self.added[part]), part)]
                continue
            at = 0
            while at < len(part):
                stop = len(part) if at + PIECE >= len(part) else part.find(" ", at + PIECE)
                stop = len(part) if stop < 0 else stop
                yield [e for w in self.words_of(part[at:stop]) if (e := self.words.get(w) or self.word(w))[0]]
                at = stop

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.entries(text) for e in part for i in e[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, as the library joins them where a file names no decoder."""
        names = {i: t for t, i in self.added.items()}
        return " ".join(names.get(i) or self.automaton.labels[i] for i in ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, SHA-256 of the ids, SHA-256 of the decoded text) without holding either whole."""
        n, ids, labels, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
        for part in self.entries(text):
            if part:
                n += sum(e[0] for e in part)
                ids.update((gap + " ".join([e[1] for e in part])).encode())
                labels.update((gap + " ".join([e[2] for e in part])).encode())
                gap = " "
        return n, ids.hexdigest(), labels.hexdigest()


_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_encoders: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The worker's encoder of a tokenizer file's content; compiled once."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_tokens, ids_sha256, decoded_sha256. vocabulary: path of a tokenizer file on the driver.

    The file's content (its size doesn't depend on the data) is broadcast. Null texts count as empty: no tokens. Repeated
    rows give repeated rows, an empty table none, texts of any length are walked piece by piece, and other columns don't
    matter, whatever their names.
    """
    with open(vocabulary, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoder(held.value)
        for batch in batches:
            rows = [enc.digest(t.as_py() or "") for t in batch.column(1)]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, schema)


def tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with the token ids of each text as array<int>; out_col replaces a column of that name."""
    with open(vocabulary, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = docs.columns.index(text_col)
    rest = [k for k, c in enumerate(docs.columns) if c.lower() != out_col.lower()]
    schema = StructType([rows.schema.fields[k] for k in rest] + [StructField("ids", ArrayType(IntegerType(), False))])

    def run(batches):
        enc = encoder(held.value)
        for batch in batches:
            ids = pa.array([enc.encode(t.as_py() or "") for t in batch.column(at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), ids], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*(docs.columns[k] for k in rest), out_col)
