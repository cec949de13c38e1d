"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

A document contains a benchmark item if some stretch of its words is within
``floor(MAX_EDIT * m)`` word edits of the item's ``m`` words (lower-cased runs of
letters and digits).

The CGK embedding (Chakraborty, Goldenberg, Koucky) reads a word sequence by a
random walk: step ``j`` writes the current word and moves on if a random bit of
(step, word) is 1. Equal sequences embed equally, and an edit only disturbs the
embedding until the walks meet again, so edit distance becomes Hamming distance.
Sampling ``SAMPLES`` of the written words gives one LSH key; ``ROUNDS``
independent walks and samples reach the target recall.

* An item is embedded from ``ANCHORS`` starting points spread over it. Each
  embedding is ``STEPS`` steps long, so that a walk's drift stays small; edits
  anywhere spoil only the anchors they touch. ``recall`` of the whole scheme is
  measured in the tests for passages with the largest allowed share of edits.
* Such a walk would run off the end of an item of fewer than ``SHORT_WORDS`` words
  and on into the words after its copy. These items are cut into one piece more
  than they may have edits, so that one piece at least stands unchanged in any
  match. Each piece is embedded on its own, to its own end and with every step
  sampled, so no match of a short item is missed, whatever its edits.
* All documents' windows of each item's size are looked at. A window within the
  allowed edits holds at least ``m - K`` words of the benchmark, and at least
  ``r - K`` of its ``r`` rare words; windows below both bounds are skipped, which
  loses nothing. Words of the remaining windows are embedded as starting points.
* A key that equals an item's key proposes (item, place). Proposals whose place
  lacks the item's own words are dropped, again by a bound; the others are
  verified by exact edit distance against the best stretch around the place.

The benchmark is a stated query set: it is read in blocks of about
``BLOCK_ITEMS`` items, each broadcast and compared with all documents.

Defined cases: null and empty texts hold nothing; items of fewer than
``MIN_ITEM_WORDS`` words match nothing; an item that occurs several times in a
document is reported once, with the smallest distance, then the first place;
repeated rows are judged alike; empty tables give no matches; extra columns are
ignored or carried along (``keep``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailer.llm.common import map_batches, schema_of, with_text
from entailer.llm.words import NOT_ALNUM, U64, Words, mix, ranges, sub_batches

MAX_EDIT = 0.2
MIN_ITEM_WORDS = 5
STEPS = 24
SAMPLES = 3
ROUNDS = 6
ANCHORS = 4
SHORT_WORDS = 20  # shorter items are searched for by their pieces
PROPOSALS = 1 << 17  # of short items verified at once
BLOCK_ITEMS = 10_000
DP_CELLS = 200_000  # of one row of the edit-distance tables
RARE_ITEMS = 4  # a word is rare if fewer items hold it

MATCHES = "array<struct<item_id:long,distance:int,first_word:long,last_word:long>>"


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    """Walk seeds (round, step) and the sampled steps of each round, ascending."""
    walk = mix(np.arange(1, ROUNDS * STEPS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(mix(walk + U64(1)).reshape(ROUNDS, STEPS), axis=1)
    return walk.reshape(ROUNDS, STEPS), np.sort(order[:, :SAMPLES], axis=1)


_WALK, _SAMPLED = _seeds()


def cgk_keys(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, rnd: int,
             steps: np.ndarray | None = None) -> np.ndarray:
    """Sampled CGK embedding of ``symbols[start:end]`` for all starts in one round.

    ``steps`` are the sampled steps, ascending; those of the round by default.
    """
    at, key = starts.copy(), np.full(len(starts), rnd + 1, U64)
    steps = _SAMPLED[rnd] if steps is None else steps
    sampled = set(steps.tolist())
    for step in range(int(steps[-1]) + 1):
        inside = at < ends
        word = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], U64(0))
        if step in sampled:
            key = mix(key * U64(0x9E3779B97F4A7C15) + word)
        at += (inside & (mix(word ^ _WALK[rnd, step]) >> U64(63)).astype(bool))
    return key


def piece_keys(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Whole CGK embedding of the ``length`` words from each start, or up to its end."""
    return cgk_keys(symbols, starts, np.minimum(starts + length, ends), 0,
                    np.arange(min(3 * length, STEPS)))


def _words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), NOT_ALNUM)


def allowed(m):
    """Edits allowed for an item of ``m`` words."""
    return np.floor(MAX_EDIT * np.asarray(m) + 1e-9).astype(np.int64)


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        w = _words(pa.array(texts, pa.string()))
        enough = np.flatnonzero(w.counts >= MIN_ITEM_WORDS)
        self.ids = np.array(ids, np.int64)[enough]
        self.m = w.counts[enough]
        self.k = allowed(self.m)
        self.words = w.hashes()[ranges(w.first[:-1][enough], self.m)]
        self.first = np.concatenate([[0], np.cumsum(self.m)])
        if not len(self.m):
            return
        item = np.repeat(np.arange(len(self.m)), self.m)
        self.vocabulary, code = np.unique(self.words, return_inverse=True)
        self.n_words = len(self.vocabulary)
        # Words of each item as sorted (item, word) numbers.
        self.pairs = np.unique(item * self.n_words + code)
        self.rare = np.bincount(self.pairs % self.n_words, minlength=self.n_words) < RARE_ITEMS
        n_rare = np.bincount(item[self.rare[code]], minlength=len(self.m))
        self.sizes = np.unique(self.m)
        self.least = np.array([(n_rare - self.k)[self.m == s].min() for s in self.sizes])
        # Keys of all anchors: (round, key) -> item and the anchor's offset.
        long = np.flatnonzero(self.m >= SHORT_WORDS)
        step = np.maximum(self.m[long] - STEPS // 2, 0)[:, None]
        offsets = (step * np.arange(ANCHORS) // max(ANCHORS - 1, 1))
        self.item = np.repeat(long, ANCHORS)
        self.offset = offsets.ravel()
        starts = self.first[self.item] + self.offset
        ends = self.first[self.item + 1]
        self.keys, self.order = [], []
        for rnd in range(ROUNDS if len(long) else 0):
            key = cgk_keys(self.words, starts, ends, rnd)
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.order.append(order)
        # Pieces of short items: (length, sorted keys, item, offset) for each length.
        short = np.flatnonzero(self.m < SHORT_WORDS)
        item = np.repeat(short, self.k[short] + 1)
        piece, n_pieces = ranges(np.zeros(len(short), np.int64), self.k[short] + 1), self.k[item] + 1
        offset = piece * self.m[item] // n_pieces
        lengths = (piece + 1) * self.m[item] // n_pieces - offset
        self.pieces = []
        for length in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == length)
            starts = self.first[item[of]] + offset[of]
            key = piece_keys(self.words, starts, starts + length, length)
            order = np.argsort(key, kind="stable")
            self.pieces.append((length, key[order], item[of][order], offset[of][order]))


def _places(items: Items, h: np.ndarray, code: np.ndarray, known: np.ndarray,
            end: np.ndarray) -> np.ndarray:
    """Words inside windows of an item's size that pass both bounds."""
    n = len(h)
    at = np.arange(n)
    held = np.concatenate([[0], np.cumsum(known)])
    rare = np.concatenate([[0], np.cumsum(known & items.rare[code])])
    steps = np.zeros(n + 1, np.int64)
    for size, least in zip(items.sizes.tolist(), items.least.tolist()):
        need = size - int(allowed(size))
        stop = np.minimum(at + size, end)
        good = np.flatnonzero((held[stop] - held[:-1] >= need) & (rare[stop] - rare[:-1] >= least))
        steps += np.bincount(good, minlength=n + 1) - np.bincount(stop[good], minlength=n + 1)
    return np.flatnonzero(np.cumsum(steps[:n]) > 0)


def _proposals(items: Items, h: np.ndarray, places: np.ndarray,
               end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Item, presumed first word, and place of every key that equals an item's key."""
    found_item, found_start, found_place = [], [], []
    for rnd, keys in enumerate(items.keys):
        key = cgk_keys(h, places, end[places], rnd)
        lo = np.searchsorted(keys, key, side="left")
        n = np.searchsorted(keys, key, side="right") - lo
        hit = np.flatnonzero(n)
        anchor = items.order[rnd][ranges(lo[hit], n[hit])]
        found_item.append(items.item[anchor])
        found_place.append(np.repeat(places[hit], n[hit]))
        found_start.append(found_place[-1] - items.offset[anchor])
    if found_item:
        yield np.concatenate(found_item), np.concatenate(found_start), np.concatenate(found_place)
    for length, keys, item, offset in items.pieces:
        key = piece_keys(h, places, end[places], length)
        lo = np.searchsorted(keys, key, side="left")
        n = np.searchsorted(keys, key, side="right") - lo
        hit = np.flatnonzero(n)
        # Short pieces may be common: few proposals at a time.
        total = np.cumsum(n[hit])
        cuts = np.searchsorted(total, np.arange(PROPOSALS, total[-1] if len(hit) else 0, PROPOSALS))
        for part in np.split(hit, cuts):
            piece = ranges(lo[part], n[part])
            place = np.repeat(places[part], n[part])
            yield item[piece], place - offset[piece], place


def _edit_distance(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest edit distance of each row of ``a`` to a stretch of that row of ``b``.

    Also the end of the first such stretch. One DP row per word of ``a`` for all
    rows at once; 0 in ``b`` is padding and equals nothing.
    """
    width = np.arange(b.shape[1] + 1)
    row = np.zeros((len(b), b.shape[1] + 1), np.int32)
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (a[:, i, None] != b), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - width, axis=1) + width
    stop = row.argmin(1)
    return row[np.arange(len(row)), stop], stop


def _verify(items: Items, h: np.ndarray, code: np.ndarray, known: np.ndarray, item: np.ndarray,
            start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple]:
    """Exact check of proposals of texts ``[lo, hi)``: item, distance, first, last word."""
    for size in np.unique(items.m[item]).tolist():
        of_size = np.flatnonzero(items.m[item] == size)
        k = int(allowed(size))
        block = start[of_size] // (k + 1)
        rows = np.unique(np.stack([item[of_size], lo[of_size], hi[of_size], block], 1), axis=0)
        q, text_lo, text_hi, block = rows.T
        width = size + 3 * k + 1
        begin = block * (k + 1) - k
        at = begin[:, None] + np.arange(width)
        inside = (at >= text_lo[:, None]) & (at < text_hi[:, None])
        at = np.clip(at, 0, len(h) - 1)
        # Bound: the stretch holds at least m - k words of this item.
        pair = np.where(inside & known[at], q[:, None] * items.n_words + code[at], -1)
        slot = np.minimum(np.searchsorted(items.pairs, pair), len(items.pairs) - 1)
        enough = (items.pairs[slot] == pair).sum(1) >= size - k
        for part in np.array_split(np.flatnonzero(enough), 1 + int(enough.sum()) * width // DP_CELLS):
            if not len(part):
                continue
            a = items.words[items.first[q[part]][:, None] + np.arange(size)]
            b = np.where(inside[part], h[at[part]], U64(0))
            distance, stop = _edit_distance(a, b)
            good = np.flatnonzero(distance <= k)
            if not len(good):
                continue
            # The same backwards from the end gives the first word.
            back = np.where(np.arange(width) < stop[good, None], b[good], U64(0))[:, ::-1]
            first = width - _edit_distance(a[good][:, ::-1], back)[1]
            base = begin[part[good]]
            yield q[part[good]], text_lo[part[good]], distance[good], base + first, base + stop[good] - 1


def find_matches(items: Items, texts: pa.Array) -> list[list[dict] | None]:
    """Matches of every text: one per item, best distance first, then first place."""
    out: list[list[dict] | None] = [[] for _ in range(len(texts))]
    if not len(items.ids):
        return out
    w = _words(texts)
    if not len(w):
        return out
    h = w.hashes()
    code = np.minimum(np.searchsorted(items.vocabulary, h), items.n_words - 1)
    known = items.vocabulary[code] == h
    text = w.text_of()
    end = w.first[text + 1]
    places = _places(items, h, code, known, end)
    if not len(places):
        return out
    best: dict[tuple[int, int], tuple] = {}
    for item, start, place in _proposals(items, h, places, end):
        own = text[place]
        for q, lo, distance, first, last in _verify(
                items, h, code, known, item, start, w.first[own], w.first[own + 1]):
            for t, *row in zip(text[lo].tolist(), q.tolist(), distance.tolist(),
                               (first - lo).tolist(), (last - lo).tolist()):
                best[t, row[0]] = min(best.get((t, row[0]), tuple(row[1:])), tuple(row[1:]))
    for (t, q), (distance, first, last) in sorted(best.items()):
        out[t].append({"item_id": int(items.ids[q]), "distance": distance,
                       "first_word": first, "last_word": last})
    return out


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK_ITEMS`` items."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                            F.col("text").cast("string").alias("text")).where(
        F.col("text").isNotNull() & F.col("item_id").isNotNull())
    n = max(1, -(-rows.count() // BLOCK_ITEMS))
    for block in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()
        part.sort()
        yield Items([r["item_id"] for r in part], [r["text"] for r in part])


def find_items(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs(text, ...)`` with ``matches`` of ``benchmark(item_id, text)``.

    ``matches`` lists, for every item found, its smallest edit distance in words
    and the first and last word of that place.
    """
    rows, text = with_text(docs, keep, F.array().cast(MATCHES).alias("matches"))
    carried = list(dict.fromkeys([*keep, text]))
    schema = schema_of(rows, carried) + "matches " + MATCHES

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for sub in sub_batches(batch, text):
                    old = sub.column("matches")
                    new = find_matches(items, sub.column(text))
                    if len(old.flatten()):
                        new = [[*a, *b] for a, b in zip(old.to_pylist(), new)]
                    yield pa.RecordBatch.from_arrays(
                        [*(sub.column(c) for c in carried), pa.array(new, old.type)],
                        names=[*carried, "matches"])
        return run

    for items in _blocks(benchmark):
        rows = map_batches(rows, search(docs.sparkSession.sparkContext.broadcast(items)), schema)
    return rows.select(*keep, "matches")
