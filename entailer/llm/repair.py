"""Conversation structure repair by aligning turns to the role grammar.

A well-formed conversation has role initials ``(s?(ua)+)?``: the grammar's strings
of one length differ only in the leading ``s``, so the cheapest repair is the best
alignment of the turns to one of a few target strings. Edits: Keep (0), Rerole to
user or assistant (3), Delete (4, the only one for blank and duplicate turns), Insert
an empty user or assistant turn (3); a truncated turn that stays adds 3. Of equally
cheap repairs the one whose audit (the edits' initials in order) is ASCII-least wins.

1. Turns are sorted by range partitions and numbered by the sort, so a conversation
   that holds a third of all turns spreads over tasks. Repeated (role, text) pairs are
   found by a minimum over these numbers, joined back so that a hot pair is split.
2. Every turn becomes one letter (role initial and fault); letters are joined within
   runs of ``RUN_ROWS`` turns, then per conversation: one byte a turn, like the audit
   itself, is all that meets in a task. Texts do not.
3. A conversation is aligned by Wagner-Fischer to the target of each feasible length,
   nearest first. The cheapest alignment so far bounds both the lengths that can still
   win and, as an Ukkonen band, the cells that are filled; a cell holds the cost of
   the rest, so the backtrace can take the least letter among the cheapest moves.
   Beyond ``BLOCK`` turns the letters are aligned in blocks, once for each grammar state
   at either end, and the blocks are put together from the last to the first: work
   grows with the length, and the result is that of one alignment.
4. Audits become one row for each edit, which meets its turn's text by number.

Defined cases: a null role or text is one space; a role whose initial is none of
``s``, ``u``, ``a`` can only be reroled or deleted; turns of one number are sorted by
role, then text, null numbers first; null ids form one conversation; an empty table
gives empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entailer.llm.common import map_batches
from entailer.operators.fixpoint import pin
from entailer.operators.joins import join_back

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 24
TASK_TURNS = 100_000  # aligned by one task, about
RUN_BITS = 8
RUN_ROWS = 1 << RUN_BITS
SPACES = " \t\n\x0b\x0c\r"
INF = 1 << 60

# A turn's letter is FIRST + 4 * (place of its initial in ROLES, or 3) + fault.
ROLES = "sua"
FINE, CUT_SHORT, BLANK, DUPLICATE = range(4)
FIRST = "A"


class Turn(NamedTuple):
    role: str       # s, u, a, or - for any other
    fault: int

    @property
    def must_go(self) -> bool:
        return self.fault >= BLANK

    @property
    def stay(self) -> int:
        """What staying costs beside a new role."""
        return TRUNCATED if self.fault == CUT_SHORT else 0


@lru_cache(None)
def turn_of(letter: str) -> Turn:
    at = ord(letter) - ord(FIRST)
    return Turn((ROLES + "-")[at // 4], at % 4)


# --- Alignment of one block of turns to one target ------------------------------

def wagner_fischer(turns: list[Turn], target: str, limit: int) -> tuple[int, str] | None:
    """Cheapest edits that turn ``turns`` into ``target`` and the least audit.

    None if they cost more than ``limit``. Only cells are filled through which a path
    within the limit can run: beyond the unavoidable costs, every column that the path
    is off the diagonal of its kept turns takes an insert or a delete.
    """
    n, size = len(turns), len(target)
    usable = [0]
    for t in turns:
        usable.append(usable[-1] + (not t.must_go))
    base = sum(DELETE if t.must_go else t.stay for t in turns)
    short = sum(t.fault == CUT_SHORT for t in turns)
    room = limit - base

    def off(more: int) -> int:
        """Least cost of ``more`` columns beyond the usable turns (fewer if negative)."""
        if more >= 0:
            return INSERT * more
        cheap = min(-more, short)  # deleting a truncated turn saves its surcharge
        return cheap * (DELETE - TRUNCATED) + (-more - cheap) * DELETE

    ahead = room // INSERT
    behind = room if room <= short else short + (room - short) // DELETE
    if off(size - usable[n]) > room:
        return None
    costs: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        here, below = costs[i], costs[i + 1] if i < n else {}
        t = turns[i] if i < n else None
        for j in range(min(size, usable[i] + ahead), max(0, usable[i] - behind) - 1, -1):
            if off(j - usable[i]) + off(size - j - (usable[n] - usable[i])) > room:
                continue
            best = 0 if i == n and j == size else INF
            if t is not None:
                best = below.get(j, INF) + DELETE
                if j < size:
                    best = min(best, below.get(j + 1, INF) + _match(t, target[j]))
            if j < size and target[j] != "s":
                best = min(best, here.get(j + 1, INF) + INSERT)
            if best < INF:
                here[j] = best
    cost = costs[0].get(0, INF)
    if cost > limit:  # or no path at all
        return None
    audit, i, j = [], 0, 0
    while i < n or j < size:
        left = costs[i][j]
        if i < n and costs[i + 1].get(j, INF) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < size and target[j] != "s" and costs[i].get(j + 1, INF) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].role == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


def _match(t: Turn, symbol: str) -> int:
    if t.must_go:
        return INF
    if t.role == symbol:
        return t.stay
    return INF if symbol == "s" else REROLE + t.stay


def targets(entry: str, exit_: str, size: int) -> list[str]:
    """Grammar strings of one length between two states.

    A state is the last role initial, or ``-`` before the first.
    """
    found = []
    for head in ("", "s") if entry == "-" else ("",):
        body = size - len(head)
        if body < 0:
            continue
        pair = "au" if entry == "u" else "ua"
        text = head + (pair * (body // 2 + 1))[:body]
        if (text[-1] if text else entry) == exit_:
            found.append(text)
    return found


@lru_cache(1 << 16)
def best_alignment(letters: str, entry: str, exit_: str) -> tuple[int, str] | None:
    """Cheapest (cost, audit) over all feasible target lengths, None if there is none."""
    turns = [turn_of(x) for x in letters]
    usable = sum(not t.must_go for t in turns)
    base = sum(DELETE if t.must_go else t.stay for t in turns)
    best: tuple[int, str] | None = None
    for step in range(len(turns) + usable + 3):
        lengths = [usable] if step == 0 else [usable - step, usable + step]
        for size in lengths:
            # A length off by ``step`` costs at least one more for each missing turn.
            least = base + (INSERT * step if size > usable else step)
            if size < 0 or (best and least > best[0]):
                continue
            for target in targets(entry, exit_, size):
                most = base + DELETE * usable + INSERT * size  # everything anew
                got = wagner_fischer(turns, target, best[0] if best else most)
                if got and (best is None or got < best):
                    best = got
        if best and base + step > best[0]:
            break
    return best


# --- Whole conversations ---------------------------------------------------------

class Chain(NamedTuple):
    """An audit as linked pieces, so that long audits are not copied."""

    text: str
    rest: "Chain | None"


def chain_text(chain: Chain | None) -> str:
    parts = []
    while chain:
        parts.append(chain.text)
        chain = chain.rest
    return "".join(parts)


def chain_less(a: Chain | None, b: Chain | None) -> bool:
    i = j = 0
    while True:
        while a and i == len(a.text):
            a, i = a.rest, 0
        while b and j == len(b.text):
            b, j = b.rest, 0
        if a is b and i == j:
            return False
        if a is None or b is None:
            return a is None
        size = min(len(a.text) - i, len(b.text) - j)
        x, y = a.text[i:i + size], b.text[j:j + size]
        if x != y:
            return x < y
        i, j = i + size, j + size


def repair(letters: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation."""
    blocks = [letters[i:i + BLOCK] for i in range(0, len(letters), BLOCK)]
    rest: dict[str, tuple[int, Chain | None]] = {"-": (0, None), "a": (0, None)}
    for k in range(len(blocks) - 1, -1, -1):
        found: dict[str, tuple[int, Chain | None]] = {}
        for entry in "-sua" if k else "-":
            for exit_, (cost, chain) in rest.items():
                got = best_alignment(blocks[k], entry, exit_)
                if got is None:
                    continue
                total, new = got[0] + cost, Chain(got[1], chain)
                old = found.get(entry)
                if old is None or total < old[0] or total == old[0] and chain_less(new, old[1]):
                    found[entry] = (total, new)
        rest = found
    cost, chain = rest["-"]
    return cost, chain_text(chain)


@lru_cache(1 << 16)
def described(letters: str) -> tuple[int, int, int, int, int, str]:
    """Blank, duplicate, truncated and illegal counts, cost and audit."""
    turns = [turn_of(x) for x in letters]
    faults = [t.fault for t in turns]
    illegal = sum(a.role + b.role not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_SHORT), illegal, *repair(letters))


def edits(letters: str, audit: str) -> Iterator[tuple[int | None, str, str | None]]:
    """Turn number, edit and new role of everything that stays or is inserted."""
    at, out, system = 0, 0, None
    for edit in audit:
        turn = None if edit == "I" else at
        at += edit != "I"
        if edit == "D":
            continue
        if system is None:
            system = edit == "K" and turn_of(letters[turn]).role == "s"
        yield turn, edit, None if edit == "K" else ("user", "assistant")[(out - system) % 2]
        out += 1


# --- The operator ------------------------------------------------------------------

class Repaired(NamedTuple):
    """``conversations``: one row each (``conv_id``, counts, ``cost``, ``audit``).
    ``turns``: ``conv_id, place, role, text, edit``, the repaired conversations."""

    conversations: DataFrame
    turns: DataFrame


def _key(c: Column) -> Column:
    """An id as a key that is never null."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def _letter() -> Column:
    text = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (F.when(text == "", F.lit(BLANK)).when(F.col("pos") > F.col("first"), F.lit(DUPLICATE))
             .when(~F.right(text, F.lit(1)).isin(".", "!", "?"), F.lit(CUT_SHORT)).otherwise(F.lit(FINE)))
    initial = F.instr(F.lit(ROLES), F.substring("role", 1, 1))
    place = F.when((F.col("role") == "") | (initial == 0), F.lit(3)).otherwise(initial - 1)
    return F.char(F.lit(ord(FIRST)) + 4 * place + fault)


def sorted_turns(rows: DataFrame) -> DataFrame:
    """Turns with ``pos``, a number that rises with conversation and turn; stored."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").alias("turn"), plain("role"), plain("text"))
    rows = rows.select("*", _key(F.col("conv_id")).alias("cid"))
    order = ["cid", F.col("turn").asc_nulls_first(), "role", "text"]
    return pin(rows.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("pos", F.monotonically_increasing_id()))


def aligned(turns: DataFrame) -> DataFrame:
    """``cid``, its runs of letters, counts, cost and audit."""
    rows = turns.select("cid", "pos", "role", F.sha2("text", 256).alias("digest"),
                        F.rtrim("text", F.lit(SPACES)).alias("text"))
    # Only the end of a text matters beside its digest.
    rows = rows.withColumn("text", F.right("text", F.lit(1)))
    first = rows.groupBy("cid", "role", "digest").agg(F.min("pos").alias("first"))
    letters = join_back(rows, first, ["cid", "role", "digest"]).select("cid", "pos", _letter().alias("letter"))
    runs = letters.groupBy("cid", F.shiftright("pos", RUN_BITS).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "letter"))).alias("turns"))
    runs = runs.select("cid", F.col("turns")[0]["pos"].alias("at"), F.array_join(F.col("turns.letter"), "").alias("letters"))
    # Few bytes, much work: dealt out by the number of turns, not by size.
    parts = max(turns.sparkSession.sparkContext.defaultParallelism, turns.count() // TASK_TURNS)
    convs = runs.repartition(parts, "cid").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("at", "letters"))).alias("runs"))
    convs = convs.select("cid", F.col("runs.at").alias("at"), F.col("runs.letters").alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [described("".join(x)) for x in b.column("letters").to_pylist()]
            columns = list(zip(*found)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("cid"), b.column("at"), b.column("letters"),
                 *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.string())],
                ["cid", "at", "letters", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return map_batches(convs, run, "cid string, at array<long>, letters array<string>, blank long, "
                       "duplicate long, truncated long, illegal long, cost long, audit string")


def edit_rows(convs: DataFrame) -> DataFrame:
    """One row for each turn that stays (its ``pos``) or is inserted (no ``pos``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cid", "place", "pos", "edit", "new_role"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names)

        for b in batches:
            rows = []
            for cid, at, letters, audit in zip(*[b.column(c).to_pylist() for c in ("cid", "at", "letters", "audit")]):
                number = (p + i for p, x in zip(at, letters) for i in range(len(x)))
                done, pos = 0, None
                for place, (turn, edit, role) in enumerate(edits("".join(letters), audit)):
                    while turn is not None and done <= turn:
                        pos, done = next(number), done + 1
                    rows.append((cid, place, None if turn is None else pos, edit, role))
                    if len(rows) >= 1 << 14:
                        yield flush(rows)
                        rows = []
            yield flush(rows)

    return map_batches(convs.select("cid", "at", "letters", "audit"), run,
                       "cid string, place long, pos long, edit string, new_role string")


def repair_conversations(rows: DataFrame) -> Repaired:
    """Repairs all conversations of ``rows(conv_id, turn, role, text)``."""
    turns = sorted_turns(rows)
    convs = pin(aligned(turns))
    steps = pin(edit_rows(convs))
    ids = turns.groupBy("cid").agg(F.first("conv_id").alias("conv_id"))
    conversations = convs.join(ids, "cid").select(
        "conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    stay = steps.where(F.col("pos").isNotNull()).join(turns.select("pos", "conv_id", "role", "text"), "pos").select(
        "conv_id", "place", F.coalesce("new_role", "role").alias("role"), "text", "edit")
    added = steps.where(F.col("pos").isNull()).join(ids, "cid").select(
        "conv_id", "place", F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    return Repaired(conversations, stay.unionByName(added))


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of ``role:text`` lines in order.

    The rows of a conversation stream through one task in order, as the digest of one
    string needs; none are held.
    """
    lines = turns.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line")
    conv_type = dict(turns.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, kind = None, None, pa.int64()
        for b in batches:
            kind, ids, done = b.schema.field("conv_id").type, [], []
            for conv, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist()):
                if state is None or conv != at:
                    if state is not None:
                        ids.append(at)
                        done.append(state.hexdigest())
                    state, at = hashlib.sha256(line.encode("utf-8")), conv
                else:
                    state.update(b"\n" + line.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(done, pa.string())], ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    return map_batches(dealt, run, f"conv_id {conv_type}, sha256 string")
