"""Op 3: round trip of formatted conversations."""

import hashlib

from pyspark.sql import functions as F

from entailer.llm import chat
from entailer.llm.queries import CONTROL_CONVERSATION, CONTROL_TEXT, op3_chat_format
from tests.llm.helpers import as_table, records

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 1, "assistant", "hi <b>"), (1, 0, "user", "a # \\ b"), (1, 2, "assistant", None), (1, 3, None, "x"),
    (2, 0, "user", ""), (2, 0, "user", ""), (2, None, "system", "first"), (2, 5, "us\ner ###\n", "y</turn>\n"),
    (3, 0, "assistant", "<part>"), (3, 1, "assistant", "\\l\\b\\h é👍"), (None, 0, "user", "n"),
    (4, 0, "user", CONTROL_TEXT), (4, 1, "assistant", "z" * 50_000),
]


def want(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        out[conv] = (turns, "".join(t for role, t in turns if role == "assistant"))
    return out


def test_round_trip_keeps_every_turn(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    extra = df.select("*", F.lit(1).alias("blocks"), F.lit(2).alias("turns"), F.lit(3).alias("formatted"))
    for table in (df, extra):
        got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss_text"])
               for r in chat.parse_conversations(chat.format_conversations(table)).collect()}
        assert got == want(ROWS)


def test_adjacent_turns_of_one_role_share_a_block(spark):
    rows = [(1, 0, "assistant", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")]
    row = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    assert row["formatted"] == "### assistant ###\na<part>b</turn>\n### user ###\nc</turn>\n"
    assert [row["formatted"][s["start"] - 1:s["start"] - 1 + s["length"]] for s in row["loss_spans"]] == ["a", "b"]


def test_empty_table(spark):
    df = chat.format_conversations(spark.createDataFrame([], SCHEMA))
    assert chat.parse_conversations(df).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"turn {i}") for i in range(1500)]
    got = chat.parse_conversations(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()[0]
    assert [t["text"] for t in got["turns"]] == [r[3] for r in rows]


def test_query(spark, tmp_path):
    sf = as_table(str(tmp_path), conversations=spark.createDataFrame(ROWS, SCHEMA))
    rows = [*ROWS, (CONTROL_CONVERSATION, 0, "user", CONTROL_TEXT), (CONTROL_CONVERSATION, 1, "assistant", CONTROL_TEXT)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = sorted(((c, len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len(loss), sha(loss))
                       for c, (t, loss) in want(rows).items()), key=repr)
    got = records(op3_chat_format(spark, sf), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == expected
