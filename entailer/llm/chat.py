"""Chat formatting by relational means (native: Spark expressions only).

A conversation's rows are collected as turn structs and sorted; adjacent turns
of one role merge into one block; blocks are concatenated to one training
string with a loss mask. Template (``<...>`` and ``#`` never occur in escaped
text, so the marks are unambiguous)::

    ### <role> ###\\n<text>[<part><text>...]</turn>\\n

``<part>`` separates the turns that were merged into one block. Inside roles
and texts ``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and ``#`` becomes
``\\h``; :func:`unescape` undoes it exactly.

Defined cases: a null text or role counts as empty; turns are ordered by
``(turn, role, text)`` with nulls first, and repeated rows are all kept; a null
``conv_id`` is a conversation of its own; an empty table gives an empty result;
extra columns are ignored.

A conversation becomes one string, so its rows meet in one row of the result by
definition; only that unit is collected, nothing across conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD_END, PART, CLOSE = "### ", " ###\n", "<part>", "</turn>\n"
ASSISTANT = "assistant"
# Escape pairs in the order they are applied; undone in reverse order.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]


def escape(c: Column) -> Column:
    for raw, mark in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(mark))
    return c


def unescape(c: Column) -> Column:
    for raw, mark in reversed(ESCAPES):
        c = F.replace(c, F.lit(mark), F.lit(raw))
    return c


def _blocks(turns: Column) -> Column:
    """Sorted turns -> blocks ``(role, body, loss)`` of adjacent same-role turns."""
    n = F.size(turns)
    # 1-based positions where a new role starts, closed by n + 1.
    starts = F.concat(
        F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
            F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"])),
        F.array(n + 1))

    def block(start: Column, i: Column) -> Column:
        part = F.slice(turns, start, F.get(starts, i + 1) - start)
        return F.struct(
            F.get(turns, start - 1)["role"].alias("role"),
            F.transform(part, lambda t: t["text"]).alias("texts"))

    return F.transform(F.slice(starts, 1, F.size(starts) - 1), block)


def format_conversations(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> ``(conv_id, formatted, loss_spans)``.

    ``loss_spans`` is an array of ``(start, length)`` in code points of
    ``formatted`` (start from 1): the escaped texts of the assistant's turns.
    """
    rows = rows.select(
        "conv_id", "turn",
        escape(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    conv = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    conv = conv.select("conv_id", _blocks(F.col("turns")).alias("blocks"))
    body = F.transform("blocks", lambda b: F.concat(
        F.lit(OPEN), b["role"], F.lit(HEAD_END), F.array_join(b["texts"], PART), F.lit(CLOSE)))
    # Lengths of every text with the length of the marks before it, in order.
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(
        b["texts"], lambda t, i: F.struct(
            F.when(i == 0, F.length(b["role"]) + len(OPEN) + len(HEAD_END))
            .otherwise(len(PART)).alias("before"),
            F.length(t).alias("len"),
            F.when(i == F.size(b["texts"]) - 1, F.lit(len(CLOSE))).otherwise(0).alias("after"),
            (b["role"] == ASSISTANT).alias("loss")))))
    span = "array<struct<start:int,length:int>>"
    spans = F.aggregate(
        pieces,
        F.struct(F.lit(1).alias("pos"), F.array().cast(span).alias("spans")),
        lambda acc, p: F.struct(
            (acc["pos"] + p["before"] + p["len"] + p["after"]).alias("pos"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["pos"] + p["before"]).alias("start"), p["len"].alias("length")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return conv.select("conv_id", F.array_join(body, "").alias("formatted"),
                       spans.alias("loss_spans"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Read back: ``(conv_id, formatted, loss_spans, turns, loss_text)``.

    ``turns`` holds the original ``(role, text)`` structs in order; merged
    turns come apart again at the part marks.
    """
    blocks = F.split("formatted", CLOSE)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, HEAD_END, 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        texts = F.split(F.substr(block, F.length(head) + len(HEAD_END) + 1), PART)
        return F.transform(texts, lambda t: F.struct(role.alias("role"),
                                                     unescape(t).alias("text")))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substr(F.col("formatted"), s["start"], s["length"]))), "")
    return formatted.select(
        "conv_id", "formatted", "loss_spans",
        F.flatten(F.transform(blocks, turns_of)).alias("turns"), loss.alias("loss_text"))
