"""Op 11: repairs against a plain search over the grammar's states."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from entailer.llm import repair as R
from entailer.llm.queries import op11_conversation_repair
from tests.llm.helpers import as_table, records

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"-": "su", "s": "u", "u": "a", "a": "u"}
WHITE = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """(cost, audit) of the least repair of ``[(role initial, must go, truncated)]``."""
    @lru_cache(None)
    def rest(i, state, added):
        found = [(0, "")] if i == len(turns) and state in "-a" else []
        step = lambda cost, edit, tail: found.append((cost + tail[0], edit + tail[1])) if tail else None
        if i < len(turns):
            role, must_go, cut = turns[i]
            step(4, "D", rest(i + 1, state, 0))
            for s in NEXT[state] if not must_go else "":
                if role == s:
                    step(3 * cut, "K", rest(i + 1, s, 0))
                elif s != "s":
                    step(3 + 3 * cut, "R", rest(i + 1, s, 0))
        for s in NEXT[state] if added < 2 else "":
            if s != "s":
                step(3, "I", rest(i, s, added + 1))
        return min(found, default=None)

    for i in range(len(turns), 0, -1):  # fills the cache from the end
        for state in NEXT:
            rest(i, state, 0)
    return rest(0, "-", 0)


def letters(turns):
    return "".join(chr(65 + 4 * "sua-".index(r) + (2 if go else int(cut))) for r, go, cut in turns)


def random_turns(r, n):
    return [(r.choice("suaua-"), r.random() < 0.2, r.random() < 0.25) for _ in range(n)]


def test_repairs_are_the_cheapest_with_the_least_audit():
    r = random.Random(5)
    for n in [*range(7)] * 40 + [15, 24, 25, 40, 70] * 8:
        turns = random_turns(r, n)
        assert R.repair(letters(turns)) == cheapest(tuple(turns))


def test_clean_conversations_keep_everything():
    for roles in ("ua", "sua", "uaua" * 30, "s" + "ua" * 50, ""):
        assert R.repair(letters([(x, False, False) for x in roles])) == (0, "K" * len(roles))


def test_bands_keep_the_optimum():
    """A band from any limit at or over the cost finds the same audit; below it, nothing."""
    r = random.Random(6)
    for _ in range(150):
        turns = [R.turn_of(x) for x in letters(random_turns(r, r.randrange(8)))]
        target = r.choice(["", "s"]) + "ua" * r.randrange(4)
        got = R.wagner_fischer(turns, target, 10_000)
        if got is None:
            continue
        for limit in range(got[0], got[0] + 8):
            assert R.wagner_fischer(turns, target, limit) == got
        assert R.wagner_fischer(turns, target, got[0] - 1) is None


def expected(rows):
    """The contract, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fault = zlib.crc32(key.encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            row = (turn, "user" if fault == 4 else role, text)
            turns += [row] * {0: 0, 3: 2}.get(fault, 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, marks, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in turns:
            end = text.rstrip(WHITE)
            kind = ("blank" if not end else "duplicate" if (role, text) in seen
                    else "truncated" if end[-1] not in ".!?" else None)
            seen.add((role, text))
            if kind:
                counts[kind] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
            marks.append((initial, kind in ("blank", "duplicate"), kind == "truncated"))
        cost, audit = cheapest(tuple(marks))
        lines, at, state, left = [], 0, "-", audit
        for edit in left:
            if edit != "I":
                at += 1
            if edit == "D":
                continue
            kept = turns[at - 1] if edit != "I" else None
            role = kept[1] if edit == "K" else {"u": "user", "a": "assistant"}[NEXT[state][-1]]
            state = role[0]
            lines.append(f"{role}:{kept[2] if kept else ''}")
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        out[conv] = (conv, gaps, *counts.values(), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return sorted(out.values(), key=repr)


def many_rows():
    r = random.Random(8)
    texts = ["Yes.", "no", "", " \n", None, "What? ", "same.", "same.", "é 日本!", "a.b", "!"]
    rows = []
    for conv in range(120):
        for turn in range(r.randrange(9)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn, role, f"{r.choice(['Well', 'So'])} {conv} {turn}." if r.random() < 0.6
                         else r.choice(texts)))
    rows += [(500, None, "system", "Be kind."), (500, 0, "user", "Hi."), (500, 0, "user", "Hi."),
             (500, 9, "tool", "x."), (500, 10, "", "y."), (500, 10, None, "y."), (None, 1, "user", "n."),
             (None, None, None, None), (501, -(1 << 62), "user", "far."), (501, 1 << 62, "assistant", "apart.")]
    rows += [(600, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(1500)]
    rows += [(601, i, "user", "same."  * (i % 3)) for i in range(700)]
    rows += [(602, 0, "user", "long " * 100_000), (602, 1, "assistant", "z" * 300_000 + ".")]
    return rows


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("partitions", [1, 7])
def test_query(spark, tmp_path, partitions):
    rows = many_rows()
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    df = df.select("*", *[F.lit("x").alias(c) for c in ("pos", "cid", "place", "edit", "first", "audit", "copy")])
    sf = as_table(str(tmp_path), conversations=df)
    assert records(op11_conversation_repair(spark, sf), *COLUMNS) == expected(rows)


def test_runs_longer_than_a_block_and_over_partitions(spark, monkeypatch):
    """A conversation over several partitions is numbered and repaired as one."""
    rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table is one partition else
    try:
        turns = R.sorted_turns(spark.createDataFrame(rows, SCHEMA))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert turns.select((turns["pos"] / (1 << 33)).cast("int")).distinct().count() > 1
    monkeypatch.setattr(R, "sorted_turns", lambda _: turns)
    got = R.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    assert records(got.conversations, "cost", "audit") == [(0, "K" * 4000)]
    assert records(got.turns, "place", "role", "text") == sorted(((i, r, t) for _, i, r, t in rows), key=repr)


def test_empty_table(spark, tmp_path):
    sf = as_table(str(tmp_path), conversations=spark.createDataFrame([], SCHEMA))
    assert op11_conversation_repair(spark, sf).count() == 0
