"""Exact dedup by an exchange of Golomb-coded fingerprints.

Two texts are equal if they are identical after every run of white space
``[\\x20\\x09-\\x0D]+`` became one space. Texts do not move to be compared:

1. Rows are stored in the shared folder with their normalised text and a 64-bit
   fingerprint, bucketed by *sender*: a run of at most ``UNIT_ROWS`` rows of one
   input partition.
2. A sender sorts its distinct fingerprints, cuts them to as many bits as the
   number of rows calls for, splits them by range among *owners* and Golomb-codes
   the gaps (power-of-two parameter): one short message for each owner.
3. An owner decodes the messages of its range and answers each with a bitmap: which
   of these fingerprints another sender has too. Its share is about
   ``OWNER_ROWS`` fingerprints, and a text that fills a third of the table comes
   once from each sender.
4. A sender marks its rows: a fingerprint that it has twice itself, or whose bit is
   set. The marks go back to the stored rows by bucket, so texts stay in place.
5. Only marked texts (*suspects*) are shuffled, and compared byte by byte: Spark
   groups them by the text itself, combined on the map side, so copies of a hot
   text leave a task as one row. A suspect without an equal stands alone again.

The group's verdict returns to its rows by the SHA-256 digest of the text, in a
join of plain shuffles whose hot key is split.

Defined cases: a null text is an empty text, and empty texts are equal to each
other; of rows with the same smallest id the one read first stays; a null id
counts as larger than any other, so it names a group only where all ids are null;
an empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entailer.llm.common import give_back, ship
from entailer.operators.fixpoint import pin, store_in_place

UNIT_BITS = 16
UNIT_ROWS = 1 << UNIT_BITS  # rows of a sender at most
OWNER_ROWS = 1 << 20        # fingerprints of an owner, about
SPARE_BITS = 12             # one in 2**12 rows is suspected wrongly, about

U64 = np.uint64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


# --- Golomb coding of sorted fingerprints -------------------------------------

def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes]:
    """Sorted distinct ``values`` below ``span`` as (parameter bits, code).

    Gaps are cut at ``2**k``, near ln 2 times the mean gap. The code holds all
    quotients in unary, then all remainders.
    """
    n = len(values)
    k = max(0, int(math.log2(max(1.0, 0.69 * span / n))))
    gaps = values.astype(U64)
    gaps[1:] -= values[:-1] + U64(1)
    ones = np.cumsum((gaps >> U64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=U64)) & U64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(n: int, k: int, code: bytes) -> np.ndarray:
    data = np.frombuffer(code, np.uint8)
    low = -(-n * k // 8)
    bits = np.unpackbits(data[:len(data) - low])
    ones = np.flatnonzero(bits)[:n]
    quotients = np.diff(ones, prepend=-1) - 1
    rest = np.unpackbits(data[len(data) - low:])[:n * k].reshape(n, k).astype(U64)
    gaps = (quotients.astype(U64) << U64(k)) + (rest << np.arange(k, dtype=U64)).sum(1, dtype=U64)
    return np.cumsum(gaps + U64(1), dtype=U64) - U64(1)


class Ranges:
    """How fingerprints are cut and split among owners, from the number of rows."""

    def __init__(self, rows: int, parallelism: int):
        size = max(1, rows).bit_length()
        self.owner_bits = max(size - OWNER_ROWS.bit_length() + 1, parallelism.bit_length(), 0)
        self.bits = min(62, max(size + SPARE_BITS, self.owner_bits + 1))

    def cut(self, fps: np.ndarray) -> np.ndarray:
        return fps.view(U64) >> U64(64 - self.bits)

    @property
    def span(self) -> int:
        return 1 << (self.bits - self.owner_bits)

    def owner(self, cut: np.ndarray) -> np.ndarray:
        return (cut >> U64(self.bits - self.owner_bits)).astype(np.int64)


MESSAGE = "owner long, unit long, n int, k int, code binary"
REPLY = "unit long, owner long, n int, bitmap binary"
MARKS = "unit long, marks binary"


def sender_messages(unit: int, fps: np.ndarray, ranges: Ranges) -> Iterator[dict]:
    cut = np.unique(ranges.cut(fps))
    owner = ranges.owner(cut)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(cut)]):
        base = U64(int(owner[a]) * ranges.span)
        k, code = golomb_encode(cut[a:b] - base, ranges.span)
        yield {"owner": int(owner[a]), "unit": unit, "n": int(b - a), "k": k, "code": code}


def owner_replies(messages: list[dict]) -> Iterator[dict]:
    values = np.concatenate([golomb_decode(m["n"], m["k"], m["code"]) for m in messages])
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    twice = np.zeros(len(values), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = 0
    for m in messages:
        yield {"unit": m["unit"], "owner": m["owner"], "n": m["n"],
               "bitmap": np.packbits(twice[at:at + m["n"]]).tobytes()}
        at += m["n"]


def sender_marks(idx: np.ndarray, fps: np.ndarray, replies: list[dict], ranges: Ranges) -> bytes:
    """One bit for each row: is its text a suspect?"""
    _, inverse, counts = np.unique(ranges.cut(fps), return_inverse=True, return_counts=True)
    replies = sorted(replies, key=lambda r: r["owner"])
    twice = np.concatenate([np.unpackbits(np.frombuffer(r["bitmap"], np.uint8))[:r["n"]] for r in replies])
    marks = np.zeros(int(idx.max()) + 1, np.uint8)
    marks[idx] = (twice[inverse] == 1) | (counts[inverse] > 1)
    return np.packbits(marks, bitorder="little").tobytes()


def _numpy(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _table(rows: list[dict], names: dict[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=pa.schema(list(names.items())))


LONG, INT, BYTES = pa.int64(), pa.int32(), pa.binary()


def suspects(stored: DataFrame, ranges: Ranges) -> DataFrame:
    """``(unit, marks)`` of all senders, by the exchange of messages and bitmaps."""
    def send(group: pa.Table) -> pa.Table:
        unit = group.column("unit")[0].as_py()
        out = _table(list(sender_messages(unit, _numpy(group.column("fp")), ranges)),
                     {"owner": LONG, "unit": LONG, "n": INT, "k": INT, "code": BYTES})
        give_back()
        return out

    def own(group: pa.Table) -> pa.Table:
        out = _table(list(owner_replies(group.to_pylist())),
                     {"unit": LONG, "owner": LONG, "n": INT, "bitmap": BYTES})
        give_back()
        return out

    def mark(mine: pa.Table, replies: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return _table([], {"unit": LONG, "marks": BYTES})
        marks = sender_marks(_numpy(mine.column("idx")), _numpy(mine.column("fp")), replies.to_pylist(), ranges)
        return _table([{"unit": mine.column("unit")[0].as_py(), "marks": marks}], {"unit": LONG, "marks": BYTES})

    messages = stored.select("unit", "fp").groupBy("unit").applyInArrow(send, MESSAGE)
    replies = messages.groupBy("owner").applyInArrow(own, REPLY)
    mine = stored.select("unit", "idx", "fp")
    return mine.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(mark, MARKS)


# The bit of a row in its sender's marks.
MARKED = "(cast(conv(hex(substring(marks, int(idx div 8) + 1, 1)), 16, 10) as int) >> int(idx % 8)) & 1 = 1"


# --- The operator --------------------------------------------------------------

def exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep_id`` is the smallest id of the documents with an equal text; ``kept`` is
    true for one row of each group. The id is an integer column.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), normalised(F.col(text_column)).alias("norm"),
                       F.monotonically_increasing_id().alias("row"))
    rows = rows.select(
        F.shiftright("row", UNIT_BITS).alias("unit"), F.col("row").bitwiseAND(UNIT_ROWS - 1).alias("idx"),
        "id", "row", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha"), "norm")
    stored = store_in_place(rows, max(1, docs.rdd.getNumPartitions()), "unit")
    ranges = Ranges(stored.count(), spark.sparkContext.defaultParallelism)
    marks = pin(suspects(stored, ranges))
    # The few marks are dealt out by bucket and hashed; stored rows stay in place.
    marked = stored.join(marks.hint("shuffle_hash"), "unit").withColumn("suspect", F.expr(MARKED))
    # Smallest id first, then the row read first; a null id is past every long.
    rank = (F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
            * F.lit(str(1 << 56)).cast("decimal(18,0)") + F.col("row")).cast("decimal(38,0)")
    # One row a group of equal bytes; combined before it is shuffled.
    groups = pin(marked.where("suspect").groupBy("sha", "norm").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("first"))
        .drop("norm"))
    verdict = lambda keep, size, kept: (
        F.col("id").alias(id_column), keep.alias("keep_id"), size.alias("group_size"),
        kept.alias("kept"), F.col("sha").alias("text_sha256"))
    alone = marked.where("not suspect").select(*verdict(F.col("id"), F.lit(1).cast("long"), F.lit(True)))
    found = marked.where("suspect").select("id", "sha", rank.alias("rank")).join(groups, "sha")
    return alone.unionByName(found.select(*verdict(
        F.col("keep_id"), F.col("group_size"), F.col("rank") == F.col("first"))))
