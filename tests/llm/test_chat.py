import brute
import pytest
from gridlens.llm import chat

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a < b # c \\ d"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "assistant", "too early"), (2, 0, "user", "tie"), (2, None, "user", "no turn"),
    (3, 0, None, "no role"), (3, 1, "critic]: x", "odd role"), (3, 1, "critic]: x", "odd role"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "x</turn>\n### User: y"),
    (4, 0, "system", "s" * 100_000), (4, 1, "user", "é日本\U0001f600"), (4, 2, "assistant", "\U0001f600" * 3),
    (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_round_trip(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    assert digests(chat.read_back(chat.format_turns(turns))) == brute.turns(ROWS)


def test_text_is_the_turns_in_order_with_marks(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    rows = chat.format_turns(turns).where("conv_id = -7").orderBy("turn_no").collect()
    text = "".join(s.text for r in rows for s in r.segments)
    assert text.startswith("### User: ") and text.count("### Assistant: ") == 1 and text.count("</turn>\n") == 2
    assert [r.first_char for r in rows] == [0, rows[0].chars] and sum(r.chars for r in rows) == len(text)
    assert [s.loss for r in rows for s in r.segments] == [False] * 4 + [True, False]


def test_turn_order_is_validated(spark):
    valid = {(r.conv_id, r.turn_no): r.valid for r in chat.format_turns(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert [valid[1, i] for i in range(4)] == [True] * 4
    assert [valid[2, i] for i in range(3)] == [True, True, False]  # by turn and role; a user's turn may not end it
    assert not any(valid[3, i] for i in range(3))
    assert [valid[4, i] for i in range(3)] == [True] * 3


def test_long_conversations_are_cut(spark):
    rows = [(5, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(400)] + [(6, 7, "user", "same")] * 50 + ROWS
    turns = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(str, chat.format_turns(turns).collect()))
    assert sorted(map(str, chat.format_turns(turns, chunk=20).collect())) == whole
    assert digests(chat.read_back(chat.format_turns(turns, chunk=20))) == brute.turns(rows)


def test_clashing_columns_and_empty_table(spark):
    turns = spark.createDataFrame([(*r, "a", "b") for r in ROWS], SCHEMA + ", chunk string, segments string")
    assert digests(chat.read_back(chat.format_turns(turns))) == brute.turns(ROWS)
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0


def test_own_template(spark):
    t = chat.Template(marks={"user": "$U:", "assistant": "$A:"}, other=("$O:", "|"), end="$E", legal={chat.START: ("assistant",), "assistant": ("user",)}, loss=("user",))
    turns = spark.createDataFrame([(1, 0, "assistant", "$A:1|"), (1, 1, "user", "$E"), (1, 2, "x|$", "y")], SCHEMA)
    rows = chat.format_turns(turns, t).orderBy("turn_no").collect()
    text = "".join(s.text for r in rows for s in r.segments)
    assert list(chat.Reader(t).turns(text)) == [("assistant", "$A:1|"), ("user", "$E"), ("x|$", "y")]
    with pytest.raises(ValueError):
        chat.Template(end="")
    with pytest.raises(ValueError):
        list(chat.Reader().turns("no mark"))
