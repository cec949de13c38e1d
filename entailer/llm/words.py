"""Vectorised word handling on Arrow batches: bounds, hashes and rolling hashes.

A batch's texts are one UTF-8 byte buffer; words are byte ranges between
delimiter bytes. All delimiters used here are ASCII, so bytes suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SUB_BATCH_BYTES = 1 << 20  # texts handled at once; a longer text is handled alone

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)  # ASCII other than 0-9 A-Z a-z
NOT_ALNUM[[i for i in range(128) if not chr(i).isalnum()]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection; the splitmix64 steps)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(max(n, 2 * len(self.up)), b, U64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=U64))
        return self.up, self.down


class Multipliers:
    """A fixed odd multiplier for every offset inside a range, grown on demand."""

    def __init__(self):
        self.values = np.empty(0, U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            size = max(n, 2 * len(self.values), 1 << 10)
            self.values = mix(np.arange(1, size + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
        return self.values


_BY_OFFSET = Multipliers()


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of disjoint byte ranges, given in order.

    Every offset has a multiplier of its own: powers of one base modulo ``2**64`` would
    give some texts of regular structure equal hashes whatever the base.
    """
    if not len(starts):
        return np.empty(0, U64)
    at = np.arange(len(data))
    begin = np.zeros(len(data) + 1, np.int64)
    begin[starts] = starts
    offset = at - np.maximum.accumulate(begin[:-1])
    longest = int((ends - starts).max())
    offset = np.minimum(offset, longest)  # bytes between ranges count for none
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _BY_OFFSET.upto(longest + 1)[offset], dtype=U64, out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(U64) * U64(0xE7037ED1A0B428DB))


CHECKED_BYTES = 1 << 18  # compared at once


def distinct_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct byte range and, for every range, which one it equals.

    Hashes find equal ranges; every range is then compared with the first of its
    group byte by byte, so the result does not rest on them.
    """
    hashes = range_hashes(data, starts, ends)
    first, inverse = np.unique(hashes, return_index=True, return_inverse=True)[1:]
    lengths, like = ends - starts, first[inverse]
    equal = bool((lengths == lengths[like]).all())
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while equal and at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + CHECKED_BYTES, side="right")) - 1)
        if to == at + 1:  # perhaps one long range
            a, b = int(starts[at]), int(starts[like[at]])
            equal = bool((data[a:a + lengths[at]] == data[b:b + lengths[at]]).all())
        else:
            mine = ranges(starts[at:to], lengths[at:to])
            equal = bool((data[mine] == data[ranges(starts[like[at:to]], lengths[at:to])]).all())
        at = to
    if equal:
        return first, inverse
    ids: dict[bytes, int] = {}  # hashes collided: group by the bytes themselves
    raw = data.tobytes()
    inverse = np.fromiter((ids.setdefault(raw[a:b], len(ids)) for a, b in zip(starts.tolist(), ends.tolist())),
                          np.int64, len(starts))
    return np.unique(inverse, return_index=True)[1], inverse


class Rolling:
    """Hashes of arbitrary ranges of a sequence of 64-bit symbols in O(1) each."""

    def __init__(self, symbols: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * up[:len(symbols)], dtype=U64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts]
                   + (ends - starts).astype(U64))


def sub_batches(batch: pa.RecordBatch, column: str = "text",
                limit: int = SUB_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the offsets of each text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


class Words:
    """Words of a batch: byte ranges and the first word of every text."""

    def __init__(self, texts: pa.Array, delimiters: np.ndarray):
        self.data, self.bounds = buffers(texts)
        n = len(self.data)
        inside = ~delimiters[self.data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = self.bounds[1:-1]
            before[edges[edges < n]] = False
            after[edges[edges > 0] - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """Index of the text of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """First place of every distinct word, and each word's number; compared by bytes."""
        return distinct_ranges(self.data, self.starts, self.ends)

    def vocabulary(self) -> tuple[list[bytes], np.ndarray]:
        """Distinct words, and each word's number in them."""
        first, inverse = self.distinct()
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[first].tolist())], inverse

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of per-byte flags for every text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + l)`` for every pair."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in a range ``[start, end)``."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0
