"""Chat formatting round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cloudstrata.llm import chat

HARD = st.lists(st.sampled_from(["\\", "</turn>", "<turn user>", "\n", "### Assistant:", "<|end|>", "<chat 1>", "a", " ", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), st.text(max_size=4)), st.one_of(HARD, st.text(max_size=20))), max_size=5))
def test_round_trip(turns):
    text, spans, level = chat.format_turns(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b], level) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (2, None, None, "</turn>"), (None, 0, "assistant", "x"), (1, 1, "assistant", "yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 1, None: 1}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nyes\nassistant\nyes\n").hexdigest()
    assert got[1]["loss_chars"] == 6 and got[1]["loss_sha256"] == hashlib.sha256(b"yesyes").hexdigest()
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_parts(spark):
    """A conversation of many turns in parts, with one turn that needs escapes at its end, and a very long turn; stored and read again in any order."""
    turns = [(1, k, ("user", "assistant")[k % 2], f"turn {k} says é something") for k in range(200)] + [(1, 200, "assistant", "</turn>\n<turn user>"), (2, 0, "assistant", "x" * 3_000_000), (2, 0, "assistant", "x" * 3_000_000), (3, 0, "user", "")]
    df = spark.createDataFrame([(*t, "other") for t in turns], "conv_id long, turn int, role string, text string, part string").repartition(3)
    formatted = chat.format_chats(df, 300)
    parts = formatted.filter("conv_id = 1").orderBy("part").collect()
    assert len(parts) > 5 and {p["escape_level"] for p in parts} == {1}
    assert chat.parse("".join(p["formatted"] for p in parts)) == [t[2:] for t in turns if t[0] == 1]
    want = {}
    for conv in (1, 2, 3):
        mine = [t for t in turns if t[0] == conv]
        loss = "".join(t[3] for t in mine if t[2] == "assistant")
        want[conv] = (len(mine), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for got in (chat.read_back(formatted, in_order=True), chat.read_back(formatted.repartition(5))):
        assert {r["conv_id"]: tuple(r)[1:5] for r in got.collect()} == want
