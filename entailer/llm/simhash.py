"""SimHash near-duplicates with Golay-code fuzzy hashing.

A text's 64-bit fingerprint is the bitwise majority of the XXH64 values of its
word shingles. Fingerprints that differ in at most ``MAX_BITS`` bits are linked;
components of links are the groups of near copies.

Candidates. A fingerprint is cut into segments of 23, 23 and 18 bits (the last
one padded). The binary Golay code of length 23 is perfect: every segment lies
within 3 bits of one codeword. A segment's keys are the codewords within 4 bits
of it, which are 1 or 6. Two segments that differ in at most 2 bits share a key;
if they differ in at most 1 bit, one's nearest codeword is a key of the other. By
the pigeonhole principle 4 differing bits leave either

* one segment equal and another with at most 2 differing bits: the key is the
  equal segment and a codeword of the other (families 0 to 5), or
* no segment equal, hence two segments with exactly 1 differing bit: the key is
  a pair of codewords, nearest on the left side, all keys on the right
  (families 6 to 8).

The join on keys verifies the bit distance and emits a pair only in the first
family that its bit difference guarantees, so a pair appears a few times at most.

Scale. Equal fingerprints are one row from the start, so exact copies cost
nothing. A dense group of near copies would still link quadratically: first,
fingerprints that agree on two whole segments are linked to the smallest of them
(a star, linear), and the join then only looks for links between different
components. Hot keys in the joins are split by AQE: no join side is an aggregate
partitioned by the join key.

Defined cases: fewer words than the shingle length give one shingle of all words,
no words (or null) the fingerprint zero, linked like any other; null ids take
part and do not become a component id while another id exists; repeated rows
share a fingerprint; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailer.llm.common import map_batches, schema_of
from entailer.llm.words import SPACE, Words, ranges, sub_batches
from entailer.operators.fixpoint import pin
from entailer.operators.sameas import same_as_clusters

SHINGLE = 4
MAX_BITS = 4
SEED = 42
AT_ONCE = 1 << 16  # shingles hashed at once
KEY_ROWS = 2048  # fingerprints given keys at once
GENERATOR = 0b101011100011  # of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, CHECKS, RADIUS = 23, 11, 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
ORDERED_PAIRS = list(itertools.permutations(range(3), 2))
PAIRS = list(itertools.combinations(range(3), 2))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def text_fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints of all texts (A-Z lower-cased, words between ASCII space)."""
    w = Words(texts, SPACE)
    if not len(w):
        return np.zeros(len(texts), np.uint64)
    # All words one after the other, each followed by one space.
    lengths = w.ends - w.starts + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    at = ranges(w.starts, lengths)
    joined = _LOWER[w.data[np.minimum(at, len(w.data) - 1)]]
    joined[ends] = 0x20
    joined = joined.tobytes()
    counts = np.where(w.counts == 0, 0, np.maximum(w.counts - shingle + 1, 1))
    first = ranges(w.first[:-1], counts)
    text = np.repeat(np.arange(len(texts)), counts)
    last = np.minimum(first + shingle, w.first[1:][text]) - 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((len(texts), 64), np.int64)
    for a in range(0, len(first), AT_ONCE):  # long texts are counted in parts
        part = slice(a, a + AT_ONCE)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(
            starts[first[part]].tolist(), ends[last[part]].tolist())], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
        cuts = np.flatnonzero(np.concatenate([[True], text[part][1:] != text[part][:-1]]))
        ones[text[part][cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    major = np.packbits(2 * ones > counts[:, None], axis=1)
    return np.ascontiguousarray(major).view(">u8")[:, 0].astype(np.uint64)


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` of ``docs(text, ...)`` with ``fp`` (the bits as a long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in sub_batches(batch, "_text"):
                fp = text_fingerprints(sub.column("_text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(sub.column(c) for c in keep), pa.array(fp)], names=[*keep, "fp"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = schema_of(docs, keep)
    return map_batches(rows, run, schema + "fp long")


class Golay:
    """Codeword indices near 23-bit words, by syndrome."""

    def __init__(self):
        patterns = np.array([sum(1 << i for i in c) for r in range(RADIUS + 1)
                             for c in itertools.combinations(range(LENGTH), r)], np.int64)
        weight = np.bitwise_count(patterns)
        at = self.syndrome(patterns)
        # Of each syndrome: the error to the nearest codeword, and all errors up to
        # RADIUS bits (one, or six: the others are absent).
        order = np.lexsort((weight, at))
        at, patterns = at[order], patterns[order]
        slot = np.arange(len(at)) - np.searchsorted(at, at)
        self.errors = np.full((1 << CHECKS, slot.max() + 1), -1, np.int64)
        self.errors[at, slot] = patterns

    @staticmethod
    def syndrome(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(LENGTH - 1, CHECKS - 1, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECKS)), rest)
        return rest

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Indices of the codewords near each word, the nearest first; -1 where absent."""
        errors = self.errors[self.syndrome(words)]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)


def key_rows(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``fps``, key and side (0 both, 1 left, 2 right) of all keys."""
    raw = fps.astype(np.uint64)
    part = [(raw >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [golay.keys(p) for p in part]
    rows, keys, sides = [], [], []

    def add(family: int, side: int, key: np.ndarray, valid: np.ndarray) -> None:
        at = np.flatnonzero(valid)
        rows.append(at)
        keys.append((family << 58) | key[at])
        sides.append(np.full(len(at), side, np.int32))

    for family, (x, y) in enumerate(ORDERED_PAIRS):
        for k in range(near[y].shape[1]):
            add(family, 0, part[x] << 12 | near[y][:, k], near[y][:, k] >= 0)
    for i, (x, y) in enumerate(PAIRS):
        family = len(ORDERED_PAIRS) + i
        add(family, 1, near[x][:, 0] << 12 | near[y][:, 0], near[x][:, 0] >= 0)
        for k, j in itertools.product(range(near[x].shape[1]), range(near[y].shape[1])):
            add(family, 2, near[x][:, k] << 12 | near[y][:, j], (near[x][:, k] >= 0) & (near[y][:, j] >= 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        for at in range(0, batch.num_rows, KEY_ROWS):
            sub = batch.slice(at, KEY_ROWS)
            rows, keys, sides = key_rows(sub.column("fp").to_numpy().view(np.uint64), golay)
            pick = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(sides), sub.column("fp").take(pick),
                 sub.column("comp").take(pick)], names=["key", "side", "fp", "comp"])


def _distance(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _first_family():
    """The first family that the difference of ``fp`` and ``fp2`` guarantees."""
    diff = F.col("fp").bitwiseXOR(F.col("fp2"))
    bits = [F.bit_count(F.shiftrightunsigned(diff, a).bitwiseAND(F.lit((1 << n) - 1)))
            for a, n in SEGMENTS]
    out = F.lit(None).cast("int")
    cases = [(bits[x] == 0) & (bits[y] <= 2) for x, y in ORDERED_PAIRS]
    cases += [(bits[x] <= 1) & (bits[y] <= 1) for x, y in PAIRS]
    for family, case in reversed(list(enumerate(cases))):
        out = F.when(case, family).otherwise(out)
    return out


def star_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` to the smallest fingerprint that agrees on two segments."""
    masks = [sum(((1 << SEGMENTS[s][1]) - 1) << SEGMENTS[s][0] for s in pair) for pair in PAIRS]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("pair", "part"))
    low = keyed.groupBy("pair", "part").agg(F.min("fp").alias("fp2")).withColumn(
        "k", F.xxhash64("pair", "part"))
    # Joined on a hash of the key: the aggregate is dealt out anew, so AQE can split both sides.
    # Three rows each from one: Spark sizes them as one, so a broadcast is not left to it.
    joined = keyed.withColumn("k", F.xxhash64("pair", "part")).join(low.hint("merge"), ["k", "pair", "part"])
    return joined.where((F.col("fp") != F.col("fp2")) & (_distance("fp", "fp2") <= max_bits)).select(
        F.col("fp").alias("a"), F.col("fp2").alias("b"))


def cross_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` between different components of ``fps(fp, comp)``."""
    keyed = map_batches(fps, _explode_keys, "key long, side int, fp long, comp long")
    left = keyed.where(F.col("side") <= 1).drop("side")
    right = keyed.where(F.col("side") != 1).select(
        "key", F.col("fp").alias("fp2"), F.col("comp").alias("comp2"))
    # Families 0 to 5 hold both fingerprints on both sides, the others every pair
    # in both orders: one order suffices.
    pair = (F.col("fp") < F.col("fp2")) & (F.col("comp") != F.col("comp2")) & (
        _distance("fp", "fp2") <= max_bits) & (
        F.shiftrightunsigned("key", 58) == _first_family())
    # About a hundred rows each from one, sized as one by Spark: never broadcast.
    return left.join(right.withColumnRenamed("key", "key2").hint("merge"),
                     (F.col("key") == F.col("key2")) & pair).select(
        F.col("comp").alias("a"), F.col("comp2").alias("b")).distinct()


def near_copies(docs: DataFrame, keep: list[str], shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """Columns ``keep`` of ``docs(doc_id, text, ...)`` with ``fp``, ``cid``, ``component_id``.

    ``cid`` names the component by a fingerprint, ``component_id`` by the
    smallest ``doc_id``. ``max_bits`` may be at most ``MAX_BITS``.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys find up to {MAX_BITS} differing bits")
    marked = pin(fingerprints(docs, keep, shingle))
    fps = pin(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    stars = pin(same_as_clusters(star_links(fps, max_bits)))
    first = pin(fps.join(stars.select(F.col("member").alias("fp"), "id"), "fp", "left").select(
        "fp", "low", F.coalesce("id", "fp").alias("comp")))
    links = same_as_clusters(cross_links(first, max_bits))
    comps = pin(first.join(links.select(F.col("member").alias("comp"), "id"), "comp", "left").select(
        "fp", "low", F.coalesce("id", "comp").alias("cid")))
    lows = comps.groupBy("cid").agg(F.min("low").alias("component_id"))
    named = pin(comps.join(lows.withColumn("k", F.xxhash64("cid")).withColumnRenamed("cid", "cid2"),
                           (F.xxhash64("cid") == F.col("k")) & (F.col("cid") == F.col("cid2"))).select(
        "fp", "cid", "component_id"))
    return marked.join(named, "fp").select(*keep, "fp", "cid", "component_id")
