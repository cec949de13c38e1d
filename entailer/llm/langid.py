"""Language identification by rank-order profiles.

A profile is the list of a language's ``TOP`` most frequent character n-grams
(1 to 3 letters, words padded by a boundary), ordered by frequency. A document
is given the language whose profile has the smallest out-of-place distance to
the document's own list: the sum over its n-grams of the difference of ranks,
``TOP`` for n-grams that the profile lacks.

Training counts the n-grams of *all* labelled training rows: tasks add up
counts, Spark sums them by (language, n-gram), and only the ``TOP`` rows of each
language reach the driver and are broadcast (``TOP`` rows a language).

Defined cases: text is lower-cased first; a text that is null or has no letter
gives ``und`` with score 0, and so does any text if nothing was learned; ties of
frequency go to the shorter, then smaller n-gram, ties of distance to the
smaller language name; every row gives a row, repeated ids included; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from entailer.llm.common import map_batches, schema_of
from entailer.llm.words import sub_batches

TOP = 300
UNDETERMINED = "und"
BOUNDARY = 1  # stands for a word's edge; below every letter
SHIFT = 21  # bits of a code point in a packed n-gram
COMPACT_ROWS = 1 << 21
CHUNK = 1 << 20

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


class Grams:
    """All n-grams of a list of texts as ids, with the text each belongs to.

    Ids are mixed-radix numbers over the letters that occur here; like packed
    n-grams they sort by length, then by code points.
    """

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        lengths = np.fromiter(map(len, low), np.int64, len(low))
        points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(low)), lengths + 1)
        letter = _is_letter()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first other character after a word is its edge
        symbols, doc, letter = points[keep], doc[keep], letter[keep]
        present = np.zeros(0x110000, bool)
        present[symbols[letter]] = True
        self.alphabet = np.concatenate([[BOUNDARY], np.flatnonzero(present)])
        code = np.zeros(0x110000, np.int64)
        code[self.alphabet] = np.arange(len(self.alphabet))
        s = np.concatenate([[0], np.where(letter, code[symbols], 0)])
        doc = np.concatenate([doc[:1] if len(doc) else [0], doc])
        self.base = b = len(self.alphabet)
        one = s > 0
        pair = s[:-1] * b + s[1:]
        middle = s[1:-1] > 0
        triple = (pair[:-1] * b + s[2:])[middle]
        self.ids = np.concatenate([s[one], b + pair, b + b * b + triple])
        self.docs = np.concatenate([doc[one], np.where(s[:-1] > 0, doc[:-1], doc[1:]), doc[1:-1][middle]])

    def pack(self, ids: np.ndarray) -> np.ndarray:
        """Ids -> n-grams packed by code point, the same in every batch."""
        b, a = self.base, self.alphabet
        n = 1 + (ids >= b) + (ids >= b + b * b)
        rest = ids - np.where(n == 1, 0, np.where(n == 2, b, b + b * b))
        out = a[rest % b]
        out = out + (np.where(n > 1, a[rest // b % b], 0) << SHIFT)
        return out + (np.where(n > 2, a[rest // (b * b)], 0) << (2 * SHIFT))

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        """Packed n-grams -> ids here; -1 where a letter does not occur here."""
        mask = (1 << SHIFT) - 1
        points = [packed & mask, packed >> SHIFT & mask, packed >> (2 * SHIFT)]
        code = np.full(0x110000, -1, np.int64)
        code[self.alphabet] = np.arange(self.base)
        b = self.base
        last, mid, head = (np.where(p > 0, code[p], 0) for p in points)
        known = (last >= 0) & (mid >= 0) & (head >= 0)
        n2, n3 = points[1] > 0, points[2] > 0
        ids = last + np.where(n2, mid * b, 0) + np.where(n3, head * b * b, 0)
        return np.where(known, ids + np.where(n3, b + b * b, np.where(n2, b, 0)), -1)


def _sum_counts(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    lang, gram, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((gram, lang))
    lang, gram, n = lang[order], gram[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])]))
    return lang[new], gram[new], np.add.reduceat(n, new)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    parts: list[tuple[np.ndarray, ...]] = []

    def out() -> pa.RecordBatch:
        lang, gram, n = _sum_counts(parts)
        known = pa.array(list(names), pa.string())
        return pa.RecordBatch.from_arrays(
            [known.take(pa.array(lang)), pa.array(gram, pa.int64()), pa.array(n, pa.int64())],
            names=["lang", "gram", "n"])

    for batch in batches:
        for sub in sub_batches(batch, limit=CHUNK):
            lang = np.array([names.setdefault(x, len(names)) for x in sub.column("lang").to_pylist()])
            g = Grams(sub.column("text").to_pylist())
            span = g.base + g.base ** 2 + g.base ** 3
            found, n = np.unique(lang[g.docs] * span + g.ids, return_counts=True)
            if len(found):
                parts.append((found // span, g.pack(found % span), n))
            if sum(len(p[0]) for p in parts) > COMPACT_ROWS:
                parts[:] = [_sum_counts(parts)]
                if len(parts[0][0]) > COMPACT_ROWS:
                    yield out()
                    parts.clear()
    if parts:
        yield out()


def train_profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``docs(text, lang)`` -> ``(lang, rank, gram)``: the ``top`` n-grams of each language."""
    rows = docs.select(F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = map_batches(rows, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    # A bound on the bare row number lets Spark cut every task's rows to ``top`` before the shuffle.
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place).where(F.col("place") <= top).select(
        "lang", (F.col("place") - 1).alias("rank"), "gram")


class Profiles:
    """Rank of every profiled n-gram in every language (``top`` where absent)."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int = TOP):
        self.top = top
        self.names = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[2] for r in rows}), np.int64)
        self.ranks = np.full((len(self.grams), len(self.names)), top, np.int32)
        at = {n: i for i, n in enumerate(self.names)}
        for lang, rank, gram in rows:
            self.ranks[np.searchsorted(self.grams, gram), at[lang]] = rank


def _top_grams(g: Grams, n_docs: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc, rank and id of every document's ``top`` n-grams, by doc and rank."""
    span = g.base + g.base ** 2 + g.base ** 3
    keys, n = np.unique(g.docs * span + g.ids, return_counts=True)
    doc, ids = keys // span, keys % span
    order = np.lexsort((-n, doc)) if len(n) else np.empty(0, np.int64)  # stable: ties by id
    doc, ids = doc[order], ids[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(n_docs))[doc]
    keep = rank < top
    return doc[keep], rank[keep], ids[keep]


def classify(texts: list[str | None], profiles: Profiles) -> tuple[list[str], np.ndarray]:
    """Predicted language and score (1 - distance / largest distance) of each text."""
    g = Grams(texts)
    doc, rank, ids = _top_grams(g, len(texts), profiles.top)
    known = g.unpack(profiles.grams)
    order = np.argsort(known, kind="stable")
    at = np.searchsorted(known[order], ids)
    at[at == len(known)] = 0
    hit = (known[order[at]] == ids) if len(known) else np.zeros(len(ids), bool)
    n_langs = len(profiles.names)
    ranks = np.full((len(ids), n_langs), profiles.top, np.int32)
    ranks[hit] = profiles.ranks[order[at[hit]]]
    place = np.where(ranks < profiles.top, np.abs(ranks - rank[:, None]), profiles.top)
    total = np.stack([np.bincount(doc, place[:, k], len(texts)) for k in range(n_langs)], 1)
    size = np.bincount(doc, minlength=len(texts))
    best = total.argmin(1)
    score = 1 - total[np.arange(len(texts)), best] / np.maximum(size * profiles.top, 1)
    names = np.array(profiles.names, object)
    return np.where(size > 0, names[best], UNDETERMINED).tolist(), np.where(size > 0, score, 0.0)


def identify(docs: DataFrame, profiles: DataFrame, keep: list[str], top: int = TOP) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the columns ``keep`` of ``docs(text, ...)``."""
    model = Profiles([tuple(r) for r in profiles.select("lang", "rank", "gram").collect()], top)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for batch in batches:
            for sub in sub_batches(batch, "_text", CHUNK):
                texts = sub.column("_text").to_pylist()
                if profiles.names:
                    langs, scores = classify(texts, profiles)
                else:
                    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(sub.column(c) for c in keep), pa.array(langs, pa.string()),
                     pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return map_batches(rows, predict, schema_of(docs, keep) + "lang_pred string, score double")
