import hashlib
import re

import pytest

from bitloom.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    """The contract's base, by its own patterns."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), list(PATTERNS).index(kind), m.end()))
    return sorted(out)


TEXTS = [
    None, "", "a@b", "a@b.c", "x a.b@c.d.e-f g@h.i", "a@b.c@d.e", "@@a@b.c", "300.1.1.1.5 1.2.3.4.5.6.7.8", "1.2.3", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713",
    "+1 2", "+12345678901234567", "é\U0001f600 a@b.c 1.1.1.1", "+49.30.1234567 4111111111111111", "٤@b.c ٣.1.1.1", "a@b.c\na@b.c",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_are_the_contract(text):
    assert pii.identifiers(text or "") == plain(text)


def test_random_texts():
    import random

    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice("a1 2.@+-()4,9") for _ in range(40))
        assert pii.identifiers(t) == plain(t)


DISGUISED = [
    ("email", "write to [john.doe (at) mail7 [dot] example dot com] now"),
    ("email", "or [john dot doe at mail dot example dot com]!"),
    ("email", "[jоhn.34@mаil7.example.com]"),
    ("email", "[john@mail dot example dot com]"),
    ("email", "see [und.34 at mail7.example.com]"),
    ("email", "[me@mail . example . com]"),
    ("email", "[ｊohn＠mail．example．com]"),
    ("ip", "ip [97[.]51[.]17[.]173] ok"),
    ("ip", "[one two nine dot 38 dot 82 dot 176]"),
    ("phone", "call [plus four nine one seven one two three four five six seven]"),
    ("phone", "+ [+１ (487) 555-7209]"),
    ("card", "card [four one one one one one one one one one one one one one one one] ok"),
    ("card", "[4111​1111​1111​1111]"),
    ("card", "[4111 1111 1111 l111]"),
    ("card", "[4Il1 1111 1111 IIl1]"),
    ("email", "[john_at_example_dot_com]"),
    ("email", "[john&#64;example&#46;com]"),
    ("email", "[john AT example DOT com]"),
    ("phone", "[+eins zwei drei vier fünf sechs sieben acht neun null]"),
]


@pytest.mark.parametrize("kind,marked", DISGUISED)
def test_disguises_are_found_at_their_source(kind, marked):
    start = marked.index("[")
    text = marked[:start] + marked[start + 1 :]
    end = text.rindex("]")
    text = text[:end] + text[end + 1 :]
    base, every = pii.spans(text)
    assert (start, pii.KINDS.index(kind), end) in every and base == plain(text)


@pytest.mark.parametrize(
    "kind,text,rest",
    [
        ("email", "j\u043ehn@example.com", "hn@example.com"),
        ("email", "jane [dot] doe@example.com", "doe@example.com"),
        ("email", "john@example.c\u043em", "john@example.c"),
        ("phone", "+49 170 12345 six seven eight", "+49 170 12345"),
    ],
)
def test_a_base_span_that_is_a_remainder_hides_nothing(kind, text, rest):
    k, at = pii.KINDS.index(kind), 3 + text.index(rest)
    base, every = pii.spans(f"to {text} now")
    assert base == plain(f"to {text} now") == [(at, k, at + len(rest))]
    assert every == sorted([*base, (3, k, 3 + len(text))])
    assert pii.masked(f"to {text} now") == f"to [{kind.upper()}] now"


@pytest.mark.parametrize("after", [" ein Haus", " Un an", " one day"])
def test_an_article_after_a_number_is_prose(after):
    assert pii.masked("+1 (848) 555-1373" + after) == "[PHONE]" + after


@pytest.mark.parametrize("text", ["we met at ten and a dot of two three ink", "at the point of no return", "one two", "look at example.com", "version 1.2.3 at home", "Er war um null Uhr da, neun oder zehn", "un deux trois nous irons au bois"])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == ([], []) and pii.masked(text) == text


@pytest.mark.parametrize("unit", ["a", "1", "1.", "+1 ", "one ", "@", "a@", "a.b at ", "x dot ", "1 ", "- ", "(", " ", "one  ", "a.a-"])
def test_odd_long_texts_take_linear_time(unit):
    import time

    began = time.time()
    pii.spans(unit * (40_000 // len(unit)))
    assert time.time() - began < 5


def test_query_columns_and_masks(make_docs):
    texts = ["a@b.c and x (at) y (dot) z", None, "", "+1 (017) 555-7713\n1.2.3.4"]
    got = {r.doc_id: r for r in pii.find(make_docs(texts)).collect()}
    assert got[0].n_email == 1 and got[0].spans == "email:0:5,email:10:26" and got[0].n_disguised == 1
    assert got[0].base_sha256 == hashlib.sha256(b"email:0:5").hexdigest()
    assert got[1].spans == got[2].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[3].n_phone, got[3].n_ip) == (1, 1)
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(make_docs(texts)).collect()}
    assert masked == {0: ("[EMAIL] and [EMAIL]", 19), 1: (None, None), 2: ("", 0), 3: ("[PHONE]\n[IP]", 12)}
    assert pii.find(make_docs(texts).where("false")).collect() == []


def test_an_ip_part_of_any_length_counts_by_its_value():
    text = "0" * 401 + "1.2.3.4 " + "1" * 401 + ".2.3.4 " + "0" * 500 + ".1.1.1"
    assert [e - s for s, _, e in pii.identifiers(text)] == [408, 506] and pii.spans(text)[0] == pii.identifiers(text)


FRAGMENTS = [
    "1", "2", "25", "168", " ", "  ", "\t", ".", " . ", "[.]", "(dot)", " dot ", "DOT", "punkt", "_at_", " at ", "(at)", " @ ", "@", "<", ">", "-", "_", ",", "+", "plus ", "Plus", "one", "two ", "double ",
    "Three", "null", "vier ", "O", "l", "Il", "a", "bob", "mail.example.com", "example", "com", "4111", "1111 ", "²", "¹", "ª", "½", "é", "ß", "ſ", "İ", "ı", "K", "о", "е", "​", "’", " ", "１", "＠", "٣", "&#64;", "%40", "%2E", "&period;", "\n",
]


def test_the_gate_in_front_changes_nothing(monkeypatch):
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 14))) for _ in range(30_000)]
    texts += ["server 1².3.4.5 ok", "192dot168dot1dot17", "192 .168 .1 .17", "ip 10 . 1 . 2 . 3"]
    with_gate = [pii.spans(t) for t in texts]
    monkeypatch.setattr(pii, "suspicious", lambda t: True)
    assert [t for t, found in zip(texts, with_gate) if pii.spans(t) != found] == []
    assert sum(len(every) > len(base) for base, every in with_gate) > 300
    assert [len(every) - len(base) for base, every in with_gate[-4:]] == [1, 1, 1, 1]
