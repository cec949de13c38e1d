"""Substring dedup on a compacted de Bruijn graph of word windows.

Every window of ``WINDOW`` words is an edge of the graph (from its first to its
last ``WINDOW - 1`` words). A word covered by an edge that occurs more than once
is removed, in every place.

* *Paths.* Consecutive edges of a document whose smallest ``KMER``-word hash (the
  minimizer) is the same occurrence form a path. Where paths are cut depends on
  their words only, so repeated text has repeated paths. A path is one row
  ``(m, s)``: minimizer hash and hash of all its words.
* *Repeated minimizers.* An edge can only repeat if its minimizer does. A count
  of minimizers, 8 bytes a path, keeps the paths that need a look.
* *Nonbranching paths.* Paths that occur more than once as a whole are found by
  a Spark join on ``(m, s)``; all their edges repeat.
* *Branches.* A path that occurs once, while its minimizer repeats, borders a
  repeated region: some of its edges may repeat. Only these paths, and one
  occurrence of every repeated path with the same minimizer, are unrolled into
  edges, whose hashes are compared by another join.
* *Spans.* Repeated paths and edges go back to their source coordinates; the
  union of their word ranges is the document's repeated spans.

Edges and paths are equal if a 64-bit hash of all their words *and* the 64-bit
minimizer hash, at the same offset, agree.

Scale. Rows are paths (about one for 11 words), not windows. Join sides are
stored tables or dealt out anew, so AQE can split hot keys; counts are combined
on the map side. The texts are shuffled once: both joins to them share the
exchange.

Defined cases: null and empty texts have no words; a text shorter than a window
keeps all its words; rows that are equal in id and text repeat each other; rows
with the same id, or none, and different texts are told apart: ``_id`` is a 64-bit
hash of id and text, and ``_th`` 23 bits of another hash of the text, so that 87
bits name a text; an empty table gives an empty result; extra columns are ignored
or carried along (``keep``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailer.llm.common import map_batches, schema_of
from entailer.llm.words import SPACE, U64, Powers, Rolling, Words, covered, ranges, sub_batches
from entailer.operators.fixpoint import pin

WINDOW = 35
KMER = 8
# ``at``: second hash of the text (23 bits), first window (32 bits), windows (8 bits).
TEXT_SHIFT, FIRST_SHIFT = 40, 8
FIRST_MASK, COUNT_MASK = (1 << 32) - 1, (1 << 8) - 1

_WORD_POWERS = Powers(0xC2B2AE3D27D4EB4F)


def _rolling(w: Words) -> Rolling:
    return Rolling(w.hashes(), _WORD_POWERS)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    step = 1
    while 2 * step <= width:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    return np.minimum(a[:len(a) - (width - step)], a[width - step:])


def paths(w: Words, window: int, kmer: int) -> dict[str, np.ndarray]:
    """Paths of a batch: text, first window (word index), windows, ``m`` and ``s``."""
    empty = np.empty(0, np.int64)
    n = len(w)
    if n < window:
        return {"text": empty, "first": empty, "windows": empty, "m": empty, "s": empty}
    roll = _rolling(w)
    at = np.arange(n - kmer + 1)
    m = roll.of(at, at + kmer)
    # Smallest hash first, then the first place: the low bits hold the place.
    bits = U64(max(n - 1, 1).bit_length())
    packed = (m >> bits << bits) | at.astype(U64)
    best = (sliding_min(packed, window - kmer + 1) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    text = w.text_of()
    valid = np.flatnonzero(text[:n - window + 1] == text[window - 1:])
    if not len(valid):
        return {"text": empty, "first": empty, "windows": empty, "m": empty, "s": empty}
    place = best[valid]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    first = valid[new]
    windows = np.diff(np.concatenate([new, [len(valid)]]))
    return {"text": text[first], "first": first, "windows": windows,
            "m": m[place[new]].view(np.int64),
            "s": roll.of(first, first + windows - 1 + window).view(np.int64)}


def _minimizers(window: int, kmer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in sub_batches(batch, "_text"):
                p = paths(Words(sub.column("_text"), SPACE), window, kmer)
                yield pa.RecordBatch.from_arrays([pa.array(p["m"])], names=["m"])
    return run


def _paths(window: int, kmer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in sub_batches(batch, "_text"):
                w = Words(sub.column("_text"), SPACE)
                p = paths(w, window, kmer)
                th = sub.column("_th").to_numpy(zero_copy_only=False)[p["text"]]
                at = th << TEXT_SHIFT | (p["first"] - w.first[p["text"]]) << FIRST_SHIFT | p["windows"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p["m"]), pa.array(p["s"]),
                     sub.column("_id").take(pa.array(p["text"])), pa.array(at)],
                    names=["m", "s", "_id", "at"])
    return run


def _edges(window: int):
    """Unrolls the listed paths of each text into edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in sub_batches(batch, "_text"):
                w = Words(sub.column("_text"), SPACE)
                todo = sub.column("todo")
                text = np.repeat(np.arange(sub.num_rows), np.diff(np.asarray(todo.offsets)))
                flat = todo.flatten()
                at, m, want = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                first, count = at >> FIRST_SHIFT & FIRST_MASK, at & COUNT_MASK
                path = np.repeat(np.arange(len(at)), count)
                local = ranges(first, count)
                start = local + w.first[text[path]]
                h = _rolling(w).of(start, start + window)
                out = (at[path] >> TEXT_SHIFT << TEXT_SHIFT) | local << FIRST_SHIFT | 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m[path]), pa.array(h.view(np.int64)),
                     sub.column("_id").take(pa.array(text[path])), pa.array(out), pa.array(want[path])],
                    names=["m", "h", "_id", "at", "want"])
    return run


def _removed(w: Words, spans: pa.Array, window: int) -> np.ndarray:
    """Which words lie in a text's spans (packed as ``at``)."""
    text = np.repeat(np.arange(len(spans)), np.diff(np.asarray(spans.offsets)))
    at = spans.flatten().to_numpy(zero_copy_only=False)
    start = (at >> FIRST_SHIFT & FIRST_MASK) + w.first[text]
    return covered(len(w), start, start + (at & COUNT_MASK) - 1 + window)


def _cut(keep: list[str], window: int, collapse: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in sub_batches(batch, "_text"):
                texts = sub.column("_text")
                w = Words(texts, SPACE)
                gone = _removed(w, sub.column("spans"), window)
                left = np.concatenate([[0], np.cumsum(~gone)])[w.first]
                words = np.flatnonzero(~gone)
                # The kept words, a space after each but a text's last one.
                lengths = w.ends[words] - w.starts[words] + 1
                data = w.data[np.minimum(ranges(w.starts[words], lengths), max(len(w.data) - 1, 0))]
                stops = np.concatenate([[0], np.cumsum(lengths)])
                data[stops[1:] - 1] = 0x20
                some = np.diff(left) > 0
                last = np.ones(len(data), bool)
                last[stops[left[1:][some]] - 1] = False
                ends = stops[left[1:]] - np.cumsum(some)
                kept = pa.LargeStringArray.from_buffers(
                    len(texts), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)),
                    pa.py_buffer(data[last].tobytes())).cast(pa.string())
                removed = w.counts - np.diff(left)
                if not collapse:
                    kept = pc.if_else(pa.array(removed > 0), kept, texts)
                yield pa.RecordBatch.from_arrays(
                    [*(sub.column(c) for c in keep), pa.array(w.counts, pa.int64()),
                     pa.array(removed, pa.int64()), kept],
                    names=[*keep, "n_words", "n_removed", "kept_text"])
    return run


def repeated_spans(base: DataFrame, window: int, kmer: int) -> DataFrame:
    """``(_id, _th, spans)`` of the repeated spans of ``base(_id, _th, _text, ...)``."""
    texts = base.select("_id", "_th", "_text")
    repeated = pin(map_batches(texts.select("_text"), _minimizers(window, kmer), "m long").groupBy(
        "m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m"))
    found = pin(map_batches(texts, _paths(window, kmer), "m long, s long, _id long, at long").join(
        repeated, "m", "left_semi"))
    whole = pin(found.groupBy("m", "s").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "at")).alias("one")).where("n > 1"))
    marked = found.join(whole.select("m", "s", "n"), ["m", "s"], "left")
    single = marked.where(F.col("n").isNull()).select("_id", "at", "m")
    others = whole.join(single.select("m").distinct().withColumn("k", F.xxhash64("m")).withColumnRenamed(
        "m", "m2"), (F.xxhash64("m") == F.col("k")) & (F.col("m") == F.col("m2")), "left_semi")
    todo = single.withColumn("want", F.lit(True)).unionByName(
        others.select("one._id", "one.at", "m", F.lit(False).alias("want")))
    th = F.shiftright("at", TEXT_SHIFT).alias("_th")
    todo = todo.groupBy("_id", th).agg(F.collect_list(F.struct("at", "m", "want")).alias("todo"))
    edges = map_batches(base.join(todo, ["_id", "_th"]), _edges(window),
                        "m long, h long, _id long, at long, want boolean")
    again = edges.groupBy("m", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("m").alias("m2"), F.col("h").alias("h2"), F.xxhash64("m", "h").alias("k"))
    spots = edges.where("want").join(again, (F.xxhash64("m", "h") == F.col("k")) & (
        F.col("m") == F.col("m2")) & (F.col("h") == F.col("h2")), "left_semi")
    spans = marked.where(F.col("n").isNotNull()).select("_id", "at").unionByName(
        spots.select("_id", "at"))
    return spans.groupBy("_id", th).agg(F.collect_list("at").alias("spans"))


def drop_repeats(docs: DataFrame, keep: list[str], window: int = WINDOW, kmer: int = KMER,
                 collapse: bool = True) -> DataFrame:
    """Columns ``keep`` of ``docs(doc_id, text, ...)`` with ``n_words, n_removed, kept_text``.

    ``kept_text`` is the kept words joined by one space; with ``collapse=False``
    a text without repeats stays as it is (null included).
    """
    if not kmer <= window <= COUNT_MASK:
        raise ValueError(f"need kmer <= window <= {COUNT_MASK}")
    text = F.col("text").cast("string")
    base = docs.select(
        *keep, F.xxhash64(F.col("doc_id").cast("long"), text).alias("_id"),
        F.hash(text).cast("long").bitwiseAND(F.lit((1 << 23) - 1).cast("long")).alias("_th"),
        text.alias("_text"))
    spans = repeated_spans(base, window, kmer)
    rows = base.join(spans, ["_id", "_th"], "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<long>")))
    return map_batches(rows, _cut(keep, window, collapse),
                       schema_of(docs, keep) + "n_words long, n_removed long, kept_text string")
