"""Quality rules with suffix-array repetition.

For every text a suffix array over its words is built by prefix doubling
(vectorised over a batch of texts; a suffix never compares beyond its own text).
The rank arrays of the doubling rounds give the longest common prefix (LCP) of
neighbours in the array. A suffix lies in the LCP interval whose depth is the
larger of its two neighbouring LCP values; that depth is the length of the
longest substring starting there that occurs again, and the maximal repeated
substrings are exactly these intervals' spans. Their union covers the repeated
words.

Rules: a text fails with fewer than ``MIN_WORDS`` words, with more than half of
its words in repeated 3-word windows, with more than ``MAX_COVERED`` of its words
in maximal repeats of ``MIN_REPEAT`` or more words, or with one repeat of more
than ``MAX_REPEAT`` words.

Defined cases: a null or empty text has no words and fails; repeated rows each
give a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailer.llm.common import map_batches, schema_of, with_text
from entailer.llm.words import SPACE, Words, covered, distinct_ranges, sub_batches

MIN_WORDS = 50
WINDOW = 3
MIN_REPEAT = 10
MAX_COVERED = 0.3
MAX_REPEAT = 100
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "covered_words", "longest_repeat"]


def suffix_ranks(text: np.ndarray, word: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list]:
    """Prefix doubling: the suffix array and the rank arrays of all rounds.

    ``text`` and ``word`` give the text and word id at each position, ``ends``
    the end of its text. Round k's ranks are equal exactly where the next
    ``2**k`` words exist and are equal. Only suffixes that still share a rank
    are sorted again.
    """
    n = len(word)
    key = text * (int(word.max()) + 1 if n else 1) + word
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first slot of the group
    rank = np.empty(n, np.int64)
    rank[order] = head
    levels, step = [rank.copy()], 1
    shared = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))  # slots in larger groups
    while len(shared):
        at = order[shared]
        after = at + step
        follow = np.where(after < ends[at], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + follow
        sub = np.argsort(key, kind="stable")
        at, key = at[sub], key[sub]
        order[shared] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = shared[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = head
        shared = shared[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
        levels.append(rank.copy())
    return order, levels


def longest_repeats(order: np.ndarray, levels: list) -> np.ndarray:
    """Length of the longest repeated substring that starts at each position."""
    n = len(order)
    i, j = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    live = np.flatnonzero(levels[0][i] == levels[0][j])
    for k in range(len(levels) - 1, -1, -1):
        a, b = i[live], j[live]
        inside = (a < n) & (b < n)
        same = live[inside][levels[k][a[inside]] == levels[k][b[inside]]]
        lcp[same] += 1 << k
        i[same] += 1 << k
        j[same] += 1 << k
    depth = np.zeros(n, np.int64)
    depth[order[:-1]] = lcp
    depth[order[1:]] = np.maximum(depth[order[1:]], lcp)
    return depth


def _duplicate_lines(w: Words) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    docs = len(w.counts)
    breaks = np.flatnonzero(w.data == 0x0A)
    starts = np.concatenate([w.bounds[:-1], breaks + 1])
    doc = np.concatenate([np.arange(docs), np.searchsorted(w.bounds, breaks, side="right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    # A line ends before the next one of its text, the last one with its text.
    ends = w.bounds[doc + 1].copy()
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    ends[inner] = starts[inner + 1] - 1
    has_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    h = distinct_ranges(w.data, starts, ends)[1][has_word]
    doc = doc[has_word]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][again], minlength=docs)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text."""
    w = Words(texts, SPACE)
    docs, n = len(w.counts), len(w)
    text = w.text_of()
    out = {
        "n_words": w.counts,
        "word_chars": w.per_text(w.inside & ((w.data & 0xC0) != 0x80)),
        "n_symbols": w.per_text(SYMBOLS[w.data]),
        "n_dup_lines": _duplicate_lines(w),
    }
    if not n:
        return out | {c: np.zeros(docs, np.int64) for c in COUNTS[4:]}
    word = w.distinct()[1]
    order, levels = suffix_ranks(text, word, w.first[text + 1])
    depth = longest_repeats(order, levels)
    at = np.arange(n)
    windows, repeats = at[depth >= WINDOW], at[depth >= MIN_REPEAT]
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, text, depth)
    return out | {
        "n_repeat_words": np.bincount(text[covered(n, windows, windows + WINDOW)], minlength=docs),
        "covered_words": np.bincount(text[covered(n, repeats, repeats + depth[repeats])], minlength=docs),
        "longest_repeat": longest,
    }


def _measure_batches(keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in sub_batches(batch, text):
                counts = measure(sub.column(text))
                yield pa.RecordBatch.from_arrays(
                    [*(sub.column(c) for c in keep),
                     *(pa.array(counts[c], pa.int64()) for c in COUNTS)], names=[*keep, *COUNTS])
    return run


def repetition_rules(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs(text, ...)`` with counts, ``base_failed`` and ``kept``."""
    rows, text = with_text(docs, keep)
    counts = map_batches(rows, _measure_batches(keep, text),
                         schema_of(docs, keep) + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    method = (F.col("covered_words") <= MAX_COVERED * F.col("n_words")) & (
        F.col("longest_repeat") <= MAX_REPEAT)
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & method)
