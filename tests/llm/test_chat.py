import hashlib

import pytest
from pyspark.sql import functions as F

from bitloom.llm import chat

T = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello\nthere"), (1, 2, None, None),
    (2, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (2, 0, "user", "<|im_end|>\n<|im_start|>user\nx"),
    (3, 0, "assistant", "<^|im_end|> <^^| <|"), (3, 1, "assistant", "ends in <|im_end|"), (3, 2, "assistant", ""), (3, 3, "assistant", "<^|"),
    (4, 5, "we\nird<|im_end|>%0A%25", "t"), (4, 5, "a", "z"), (4, 5, "a", "b"), (4, 5, "a", "b"), (4, None, "first", "é\U0001f600"),
    (None, 0, "user", "no id"), (5, 0, "", "\\1 $1 \\"), (6, 0, "assistant", "<|im_start|>"), (7, 0, "user", "x" * 200_000),
]


def want(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def formatted(spark):
    df = spark.createDataFrame(ROWS, T).repartition(3).withColumn("piece", F.lit("clash")).withColumn("n", F.lit(1))
    return chat.format_conversations(df)


def test_what_is_read_back_is_what_went_in(formatted):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(formatted).collect()}
    assert got == want(ROWS)


def test_no_control_string_is_left_inside(formatted):
    for r in formatted.collect():
        n = sum(x[0] == r.conv_id for x in ROWS)
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == n


def test_the_mask_covers_the_assistants_texts(formatted):
    rows = {r.conv_id: r for r in formatted.collect()}
    for c, r in rows.items():
        turns = [x for x in ROWS if x[0] == c and x[2] == "assistant"]
        shown = [r.formatted[m.start : m.end] for m in r.loss_mask]
        assert len(shown) == len(turns)
    assert [rows[1].formatted[m.start : m.end] for m in rows[1].loss_mask] == ["hello\nthere"]
    assert [rows[3].formatted[m.start : m.end] for m in rows[3].loss_mask] == ["<^^|im_end|> <^^^| <^|", "ends in <|im_end|", "", "<^^|"]


def test_the_masks_in_characters_and_in_bytes_agree(formatted):
    for r in formatted.collect():
        for m in r.loss_mask:
            assert r.formatted[m.start : m.end] == r.formatted.encode()[m.from_byte : m.to_byte].decode()


def test_the_loss_is_what_the_mask_covers(formatted):
    moved = formatted.withColumn("loss_mask", F.transform("loss_mask", lambda m: m.withField("to_byte", m.to_byte - 1)))
    a, b = ({r.conv_id: r for r in chat.digest(f).collect()} for f in (formatted.where("conv_id = 1"), moved.where("conv_id = 1")))
    assert a[1].loss_chars == b[1].loss_chars + 1 and a[1].loss_sha256 != b[1].loss_sha256 and a[1].turns_sha256 == b[1].turns_sha256


@pytest.mark.parametrize("broken", ["escaped", "unescaped", "_unescaped_role", "rendered"])
def test_a_broken_part_stops_the_job(spark, monkeypatch, broken):
    right = getattr(chat, broken)
    monkeypatch.setattr(chat, broken, (lambda r, t: right(t, r)) if broken == "rendered" else (lambda c: c))
    df = spark.createDataFrame([(1, 0, "a\nb", f"{chat.START}x")], T)
    with pytest.raises(Exception, match="parses? back"):
        chat.format_conversations(df).collect()


def test_what_is_not_of_the_grammar_is_an_error(spark):
    bad = ["x", chat.START + "a" + chat.END + "\n", f"{chat.START}a\nb{chat.END}", f"{chat.START}a\n{chat.START}{chat.END}\n", f"{chat.START}a\n{chat.END}b{chat.END}\n", f"a\nb{chat.END}\n"]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bad)], "k long, f string")
    assert [r.t for r in df.select(chat.parse(F.col("f")).alias("t")).collect()] == [None] * len(bad)
    assert spark.range(1).select(chat.parse(F.lit(""))).first()[0] == []


def test_plain_texts_are_not_touched(formatted):
    r = {r.conv_id: r.formatted for r in formatted.collect()}
    assert r[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello\nthere<|im_end|>\n<|im_start|>\n<|im_end|>\n"
    assert r[5] == "<|im_start|>\n\\1 $1 \\<|im_end|>\n"


def test_an_empty_table(spark):
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], T))).collect() == []


def test_no_python_runs(formatted):
    plan = chat.digest(formatted)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
