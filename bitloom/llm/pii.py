"""Personal data behind disguises, with spans in the source text.

A chain of transducers rewrites a text: look-alike characters become ASCII, invisible ones go, spelled digits become
digits, at/dot disguises become the signs. Each transducer emits, for every character that it writes, the span of source
characters that it stands for, and chains compose; identifiers found in the normalised text are mapped back through
that, so spans always point into the text as it was given.

What counts as a disguise is bounded, by these definitions and not to save work: signs and spelled digits stand at most
three blanks apart; a local part is of up to 64 characters and a label of up to 63, as in addresses; a domain is of up
to nine labels apart and a spoken local part of up to four; a group of digits is of up to 19, the longest card number. Of
longer runs the pieces within these bounds are read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# ---------------------------------------------------------------- detection

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each @ outwards, so that long runs without one cost nothing."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of what the four patterns match and their checks pass, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- transducers


@dataclass
class Tape:
    """A rewritten text; its character k stands for source characters start[k] up to end[k]."""

    text: str
    start: list[int]
    end: list[int]

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, pieces: Iterator[tuple[int, int, str]]) -> Tape:
        """The tape with each (from, to, emitted) replaced, in order and apart; what is emitted stands for all of it."""
        text, start, end, at = [], [], [], 0
        for a, b, emitted in pieces:
            text += [self.text[at:a], emitted]
            start += self.start[at:a]
            end += self.end[at:a]
            if b > a:
                start += [self.start[a]] * len(emitted)
                end += [self.end[b - 1]] * len(emitted)
            at = b
        if not text:
            return self
        return Tape("".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:])


# Letters of other scripts that look like these ASCII letters.
_CYRILLIC = dict(zip("аеорсухіјѕһԁѵԛԝӏАВЕЅІЈКМНОРСТУХҮ", "aeopcyxijshdvqwlABESIJKMHOPCTYXY"))
_GREEK = dict(zip("αονιρκυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aovipkuxyABEZHIKMNOPTYX"))
_MARKS = {"＠": "@", "﹫": "@", "․": ".", "。": ".", "｡": ".", "﹒": ".", "•": ".", "∙": ".", "⋅": ".", "·": ".", "➕": "+", "﹢": "+"}
_DASHES = dict.fromkeys("‐‑‒–—―−﹣－", "-")
_SPACES = dict.fromkeys("              　", " ")
_INVISIBLE = dict.fromkeys("­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿", "")
_LOOKALIKE = _CYRILLIC | _GREEK | _MARKS | _DASHES | _SPACES | _INVISIBLE


@cache
def _plain(c: str) -> str | None:
    """What a character outside ASCII stands for, or None to leave it: the tables, digits of any script, styled forms."""
    if (known := _LOOKALIKE.get(c)) is not None:
        return known
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded != c and len(folded) == 1 and folded.isascii() else None


def _homoglyphs(t: Tape) -> Tape:
    table = {c: p for c in set(t.text) if c > "\x7f" and (p := _plain(c)) is not None}
    if not table:
        return t
    return t.rewrite((m.start(), m.end(), table[m[0]]) for m in re.finditer("[" + re.escape("".join(table)) + "]", t.text))


# The names of the digits 0 to 9 in English, German, French and Spanish.
_DIGIT_NAMES = (
    "zero one two three four five six seven eight nine".split(),
    "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
)
_DIGIT = {w: str(k) for names in _DIGIT_NAMES for k, w in enumerate(names)} | {"oh": "0", "ein": "1", "zwo": "2", "fuenf": "5"}
_TIMES = {"double": 2, "triple": 3}
# Names of digits that are articles or other common words too; "" is for nothing.
_PROSE = frozenset(["", "ein", "un", "one", "oh", "neuf"])
_NAME = "(?:" + "|".join(sorted([*_DIGIT, *_TIMES], key=len, reverse=True)) + ")"
_GAP = r"[\x20\t]{0,3}[-,.]?[\x20\t]{0,3}"
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_NAME}(?!\w)|(?:[0-9]{{1,19}}[\x20-]){{1,19}}{_NAME}(?!\w))(?:{_GAP}(?:{_NAME}|[0-9]{{1,19}})(?!\w))*")
_UNIT = re.compile(rf"(?i)(?<!\w){_NAME}(?!\w)|[0-9]+")
_PLUS = re.compile(r"(?i)(?<!\w)plus[\x20\t]{1,3}(?=[0-9])|(?<=\+)[\x20\t]{1,3}(?=[0-9])")
_DOT_WORD = r"(?:dot|punkt|punto|point)"
_SPELLED_DOT = re.compile(rf"(?i)(?<=[0-9])[\x20\t]{{0,3}}(?:[\[({{<_-]?[\x20\t]{{0,3}}{_DOT_WORD}[\x20\t]{{0,3}}[\])}}>_-]?|[\[({{<][\x20\t]{{0,3}}\.[\x20\t]{{0,3}}[\])}}>]|(?<=[\x20\t])\.)[\x20\t]{{0,3}}(?=[0-9])")
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OolI]{1,4}(?=[\x20-]?[0-9])|(?<=[0-9][\x20-])[OolI]{1,4}(?=[0-9])")


def _spelled(t: Tape) -> Tape:
    """Runs of three digits or more, one of them spelled at least, as plain digits without what stood between."""

    def pieces():
        for m in _SPELLED.finditer(t.text):
            units = list(_UNIT.finditer(t.text, m.start(), m.end()))
            if len(units) < 3:
                continue
            before, times = None, 1
            for u in units:
                word = u[0].lower()
                if before is not None:
                    between = t.text[before : u.start()]
                    if not (t.text[before - 1].isdigit() and word[0].isdigit()) or between.strip() == "":
                        if between:
                            yield before, u.start(), ""
                before = u.end()
                if word in _TIMES:
                    times = _TIMES[word]
                    yield u.start(), u.end(), ""
                    continue
                if word in _DIGIT or times > 1:
                    yield u.start(), u.end(), _DIGIT.get(word, word) * times
                times = 1

    t = t.rewrite(pieces())
    t = t.rewrite((m.start(), m.end(), "+" if "l" in m[0].lower() else "") for m in _PLUS.finditer(t.text))
    return t.rewrite((m.start() + k, m.start() + k + 1, "0" if c in "Oo" else "1") for m in _LETTER_DIGIT.finditer(t.text) for k, c in enumerate(m[0]))


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT_MARK = re.compile(rf"(?i)(?<=[A-Za-z0-9])[\x20\t]{{0,3}}(?:{_OPEN}[\x20\t]{{0,3}}(?:at|arroba|ät|@)[\x20\t]{{0,3}}{_CLOSE}|[_-]at[_-])[\x20\t]{{0,3}}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[\x20\t]{{1,3}}@[\x20\t]{{0,3}}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[\x20\t]{{1,3}}(?=[A-Za-z0-9])")
_DOT_MARK = re.compile(rf"(?i)(?<=[A-Za-z0-9])[\x20\t]{{0,3}}(?:{_OPEN}[\x20\t]{{0,3}}(?:{_DOT_WORD}|\.)[\x20\t]{{0,3}}{_CLOSE}|[_-]{_DOT_WORD}[_-])[\x20\t]{{0,3}}(?=[A-Za-z0-9])")
_DOTTED = re.compile(rf"(?i)(?<=[A-Za-z0-9])[\x20\t]{{1,3}}(?:{_DOT_WORD}|\.)[\x20\t]{{1,3}}(?=[A-Za-z0-9])")
_ENTITY = re.compile(r"(?i)(?P<at>&(?:#64|#x40|commat);|%40)|&(?:#46|#x2e|period);|%2e")
_WS = r"[\x20\t]{1,3}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_SPOKEN = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_WS}{_DOT_WORD}{_WS}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}(?P<at>{_WS}(?:at|arroba){_WS}|@){_LABEL}(?:\.{_LABEL}){{0,8}}(?:{_WS}(?:{_DOT_WORD}|\.){_WS}{_LABEL}){{1,8}}")
_HALF_SPOKEN = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])(?=[A-Za-z%+-]{{0,64}}[0-9._])[A-Za-z0-9._%+-]{{1,64}}(?P<at>{_WS}(?:at|arroba){_WS}){_LABEL}(?:\.{_LABEL}){{0,8}}\.[A-Za-z]{{2,}}")


def _at_dot(t: Tape) -> Tape:
    """Bracketed, spaced and spoken signs become @ and a full stop; bare words only where an address is around them."""
    t = t.rewrite((m.start(), m.end(), "@" if m["at"] else ".") for m in _ENTITY.finditer(t.text))
    t = t.rewrite((m.start(), m.end(), ".") for m in _DOT_MARK.finditer(t.text))
    t = t.rewrite((m.start(), m.end(), "@") for m in _AT_MARK.finditer(t.text))

    def spoken():
        for m in _SPOKEN.finditer(t.text):
            signs = [(d.start(), d.end(), ".") for d in _DOTTED.finditer(t.text, m.start(), m.end())]
            yield from sorted([*signs, (m.start("at"), m.end("at"), "@")])

    t = t.rewrite(spoken())
    t = t.rewrite((m.start("at"), m.end("at"), "@") for m in _HALF_SPOKEN.finditer(t.text))
    return t.rewrite((m.start(), m.end(), ".") for m in _SPELLED_DOT.finditer(t.text))


TRANSDUCERS: tuple[Callable[[Tape], Tape], ...] = (_homoglyphs, _spelled, _at_dot)
# What a text must hold for one of the patterns above to change it, where no look-alike does: each is a part of them that
# no match lacks. Searched apart, as one alternation would try all of them at every character, and where the text is
# ASCII in its lower case.
_HINTS = (
    rf"(?<!\w){_NAME}{_GAP}(?:{_NAME}(?!\w)|[0-9])",
    rf"[0-9][\x20-]{_NAME}(?!\w)",
    rf"{_OPEN}[\x20\t]{{0,3}}(?:at|arroba|ät|@|\.|{_DOT_WORD})[\x20\t]{{0,3}}{_CLOSE}",
    rf"[_-](?:at|{_DOT_WORD})[_-]",
    r"[0-9][\x20-]?[oli]{1,4}[\x20-]?[0-9]",
    rf"[\x20\t](?:at|arroba)[\x20\t]{{1,3}}{_LABEL}\.[a-z0-9-]",
    r"[\x20\t]\.[\x20\t]",
    r"[0-9][\x20\t]{1,3}\.[\x20\t]{0,3}[0-9]",
)
# The same behind a sign or word that must be there too.
_HINTS_WITH = (
    (("@",), r"[\x20\t]@|@[\x20\t]"),
    (("dot", "punkt", "punto", "point"), rf"(?<!\w){_DOT_WORD}(?!\w)|[0-9][\x20\t\[({{<_-]{{0,7}}{_DOT_WORD}"),
    (("plus", "+"), r"(?<!\w)plus[\x20\t]|\+[\x20\t]"),
    (("&", "%"), r"&#|&commat;|&period;|%40|%2e"),
)
_LOW_HINTS = [re.compile(p) for p in _HINTS]
_LOW_HINTS_WITH = [(marks, re.compile(p)) for marks, p in _HINTS_WITH]
_ANY_CASE_HINTS = [re.compile("(?i)" + p) for p in (*_HINTS, *(p for _, p in _HINTS_WITH))]


def suspicious(text: str) -> bool:
    """False only where no transducer changes the text; then what they would find is not looked for."""
    if text.isascii():
        low = text.lower()
        return any(p.search(low) for p in _LOW_HINTS) or any(any(m in low for m in marks) and p.search(low) for marks, p in _LOW_HINTS_WITH)
    return any(c > "\x7f" and _plain(c) is not None for c in set(text)) or any(p.search(text) for p in _ANY_CASE_HINTS)


def normalise(text: str) -> Tape:
    """The text after all transducers, each character with the source span that it stands for."""
    t = Tape.of(text)
    for step in TRANSDUCERS:
        t = step(t)
    return t


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all): what the patterns find in the text itself, and that with what they find behind disguises.

    A found span goes only where one base span holds it whole; one that reaches further stays beside the base, which may
    be a mere remainder of it, unless all it adds is one word of _PROSE ("+1 (848) 555-1373 Un an ..."). Each is (start,
    index of the kind, end).
    """
    base = identifiers(text)
    if not suspicious(text):
        return base, base
    t = normalise(text)
    if t.text == text:
        return base, base
    held, more = sorted((s, e) for s, _, e in base), []
    for s, kind, e in identifiers(t.text):
        s, e = t.start[s], t.end[e - 1]
        met = [(a, b) for a, b in held if s < b and a < e]
        if not any((text[s:a] + text[max(s, b) : e]).strip(" \t,.-").lower() in _PROSE for a, b in met):
            more.append((s, kind, e))
    return base, sorted(set(base + more)) if more else base


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, the number of base spans by kind, base_sha256, spans and the number of disguised ones.

    Null and empty texts have no spans; repeated rows are treated alike; an empty table gives none; whole texts are read,
    however long; other columns don't matter, whatever their names.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {source.schema[0].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                base, every = spans(value.as_py() or "")
                kinds = [k for _, k, _ in base]
                row = (*(kinds.count(k) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base))
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"])

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def masked(text: str) -> str:
    """The text with every span, and what overlaps it, replaced by its kind in square brackets."""
    out, at = [], 0
    found = spans(text)[1]
    k = 0
    while k < len(found):
        start, kind, end = found[k]
        k += 1
        while k < len(found) and found[k][0] < end:
            end = max(end, found[k][2])
            k += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data masked; length_col, where docs has it, becomes the new length in code points.

    A null text stays null, with its length as it was. Other columns stay as they are, whatever their names.
    """
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else masked(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.names[at], pa.array(texts, batch.schema.types[at]))

    out = rows.mapInArrow(run, rows.schema)
    if length_col and length_col in docs.columns:
        text, length = f"c{at}", f"c{docs.columns.index(length_col)}"
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.char_length(text)).cast(docs.schema[length_col].dataType))
    return out.toDF(*docs.columns)
