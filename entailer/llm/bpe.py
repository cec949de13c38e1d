"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols form a linked list; a segment tree over its positions holds the
rank of every adjacent pair, ties broken by position, so the root is the
leftmost lowest-rank merge. A merge changes three leaves (the pair itself, the
one before, and the vanished one), each with a logarithmic path to the root;
encoding ends when the root holds no rank. All words of a batch advance
together: their trees are rows of one array. Words of more than
``LONG`` symbols are merged one by one with the same tree.

The vocabulary, merges and added tokens come from a ``tokenizers`` JSON file of
the word-end BPE kind; its text is broadcast (a fixed file of a few MB). Plain
ASCII is normalised and cut by the rules stated below; other text goes through
the file's own normaliser and pre-tokeniser, whose Unicode version decides what
is a letter. Merging and decoding are done here.

White space never lies inside a word of the pattern, so texts are cut at ASCII
white space, each distinct word of a batch is encoded once, and recent words are
kept in a bounded cache (``CACHE_WORDS``).

Defined cases: a null text counts as empty and has no ids; repeated rows each
give a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from entailer.llm.common import map_batches, schema_of
from entailer.llm.words import SPACE, Words, ranges, sub_batches

LONG = 256
CACHE_WORDS = 200_000
BATCH_BYTES = 2 << 20
BATCH_IDS = 1 << 18  # ids decoded at once; a longer text is decoded alone
ROWS = 1 << 14  # words merged at once
# Fixed value: the word pattern of the public vocabulary file, for lower-case
# ASCII without white space.
ASCII_PATTERN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """Ranks and results of pair merges, looked up for whole arrays of pairs."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = max(vocab.values()) + 1
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.table = dict(zip(keys.tolist(), range(len(keys))))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it does not merge (or a side is -1)."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_rows(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """Merge all rows of ``symbols`` (rows padded by -1); -1 marks vanished symbols."""
    n, width = symbols.shape
    bits = (width - 1).bit_length()
    size = 1 << bits
    sym = np.full((n, size + 1), -1, np.int64)  # the last column stands for "no neighbour"
    sym[:, :width] = symbols
    after = np.broadcast_to(np.arange(1, size + 2), (n, size + 1)).copy()
    before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
    before[:, 0] = size
    after[:, size] = size
    position = np.arange(size)
    tree = np.full((n, 2 * size), NONE, np.int64)
    rank = merges.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, size)
    tree[:, size:] = np.where(rank == NONE, NONE, rank << bits | position)
    for node in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        root = tree[rows, 1]
        at = root & (size - 1)
        gone = after[rows, at]
        follow = after[rows, gone]
        sym[rows, at] = merges.result[root >> bits]
        sym[rows, gone] = -1
        after[rows, at] = follow
        before[rows, follow] = at
        lead = before[rows, at]
        old = np.stack([gone, at, lead])
        pair_left = sym[rows, lead]
        here = sym[rows, at]
        rank = merges.rank(np.concatenate([here, pair_left]),
                           np.concatenate([sym[rows, follow], here])).reshape(2, -1)
        leaf = np.full((3, len(rows)), NONE, np.int64)
        leaf[1] = np.where(rank[0] == NONE, NONE, rank[0] << bits | at)
        leaf[2] = np.where(rank[1] == NONE, NONE, rank[1] << bits | lead)
        # A first symbol has no pair before it: its own leaf is written twice.
        leaf[2] = np.where(lead == size, leaf[1], leaf[2])
        old[2] = np.where(lead == size, at, lead)
        node = old + size
        for k in range(3):
            tree[rows, node[k]] = leaf[k]
        for _ in range(bits):
            node >>= 1
            for k in range(3):
                tree[rows, node[k]] = np.minimum(tree[rows, 2 * node[k]], tree[rows, 2 * node[k] + 1])
        rows = rows[tree[rows, 1] != NONE]
    return sym[:, :width]


def merge_long(symbols: list[int], merges: Merges) -> list[int]:
    """The same merges for one long word."""
    n = len(symbols)
    size = 1 << (n - 1).bit_length()
    table, base = merges.table, merges.size
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    none = (NONE, 0)
    tree = [none] * (2 * size)

    def leaf(i: int) -> tuple[int, int]:
        j = after[i] if 0 <= i < n else n
        return (table.get(sym[i] * base + sym[j], NONE), i) if j < n else none

    for i in range(n - 1):
        tree[size + i] = leaf(i)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1][0] != NONE:
        rank, at = tree[1]
        gone = after[at]
        sym[at], sym[gone] = int(merges.result[rank]), -1
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        for i, value in ((gone, none), (at, leaf(at)), (before[at], leaf(before[at]))):
            if i < 0:
                continue
            node = size + i
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best
    return [s for s in sym if s >= 0]


class WordCache:
    """Distinct words of batches -> ids, with recent words kept.

    ``encode`` gives the id lists of words that are not kept yet; ``split`` finds the
    words of texts (between white space unless given).
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = CACHE_WORDS,
                 split: Callable[[pa.Array], Words] = lambda texts: Words(texts, SPACE)):
        self.encode, self.limit, self.split = encode, limit, split
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.offsets = np.zeros(1 << 16, np.int64)

    def _add(self, words: list[bytes]) -> None:
        lists = self.encode(words)
        at = len(self.index)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ends = self.offsets[at] + np.cumsum(lengths)
        if at + len(words) >= len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros(at + len(words) + 1, np.int64)])
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(int(ends[-1]), np.uint32)])
        self.ids[self.offsets[at]:ends[-1]] = np.fromiter(
            chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        self.offsets[at + 1:at + 1 + len(words)] = ends
        self.index.update(zip(words, range(at, at + len(words))))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other and the number of each text's ids."""
        if len(self.index) > self.limit:
            self._clear()
        w = self.split(texts)
        if not len(w):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        words, inverse = w.vocabulary()
        missing = [x for x in words if x not in self.index]
        if missing:
            self._add(missing)
        known = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[inverse]
        starts = self.offsets[known]
        lengths = self.offsets[known + 1] - starts
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[ranges(starts, lengths)], total[w.first[1:]] - total[w.first[:-1]]


class Bpe:
    """Encoder and decoder of one vocabulary file (given as its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.merges = Merges(model)
        vocab, symbols = model["vocab"], byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in symbols], np.int64)
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile(b"(" + b"|".join(
            re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + b")") if self.added else None
        front = Tokenizer.from_str(text)
        self.normalizer, self.pre_tokenizer = front.normalizer, front.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        tokens = {i: t for t, i in vocab.items()} | {i: t.decode() for t, i in self.added.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        joined = [(t + " ").encode() for t in self.tokens]
        self.token_bytes = np.frombuffer(b"".join(joined), np.uint8)
        self.token_lengths = np.fromiter(map(len, joined), np.int64, len(joined))
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.words = WordCache(self.encode_words)

    def pieces(self, text: bytes) -> list[bytes]:
        """Words of the pattern after normalisation, as UTF-8."""
        if text.isascii():
            return ASCII_PATTERN.findall(text.lower())
        found = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text.decode()))
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in found]

    def encode_pieces(self, raw: list[bytes]) -> list[list[int]]:
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.final[data[ends - 1]]
        starts = ends - lengths
        out: list[list[int]] = [[]] * len(raw)
        width = 1
        while width < 2 * LONG:
            rows = np.flatnonzero((lengths <= width) & (lengths > width // 2)) if width <= LONG else ()
            for a in range(0, len(rows), ROWS):
                part = rows[a:a + ROWS]
                at = starts[part, None] + np.arange(width)
                inside = np.arange(width) < lengths[part, None]
                block = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], -1)
                merged = merge_rows(block, self.merges) if width > 1 else block
                left = merged >= 0
                flat, cuts = merged[left].tolist(), np.cumsum(left.sum(1)).tolist()
                for row, i, j in zip(part.tolist(), [0, *cuts], cuts):
                    out[row] = flat[i:j]
            width *= 2
        for row in np.flatnonzero(lengths > LONG).tolist():
            out[row] = merge_long(symbols[starts[row]:ends[row]].tolist(), self.merges)
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of texts without ASCII white space; equal pieces are merged once."""
        parts: list[list[bytes | int]] = []
        for word in words:
            if self.added_pattern and b"<" in word:
                found: list[bytes | int] = []
                for i, part in enumerate(self.added_pattern.split(word)):
                    found += [self.added[part]] if i % 2 else self.pieces(part)
                parts.append(found)
            else:
                parts.append(self.pieces(word))
        distinct = list({p for ps in parts for p in ps if isinstance(p, bytes)})
        ids = dict(zip(distinct, self.encode_pieces(distinct))) if distinct else {}
        return [[i for p in ps for i in (ids[p] if isinstance(p, bytes) else (p,))] for ps in parts]

    def decode_texts(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Tokens of each text joined by spaces: all bytes and the end of each text."""
        lengths = self.token_lengths[ids]
        data = self.token_bytes[ranges(self.token_starts[ids], lengths)]
        last = np.cumsum(counts)
        ends = np.concatenate([[0], np.cumsum(lengths)])[last]
        keep = np.ones(len(data), bool)
        keep[ends[counts > 0] - 1] = False  # the space after a text's last token
        return data[keep].tobytes(), ends - np.cumsum(counts > 0)


_models: dict[tuple, object] = {}


def cached_model(kind: type, text: str):
    """One model per worker process and vocabulary, kept between tasks."""
    key = (kind.__name__, hash(text))
    if key not in _models:
        _models.clear()
        _models[key] = kind(text)
    return _models[key]


def _offsets(ends: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _decode(model: Bpe, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Decoded texts, a bounded number of ids at a time."""
    total, parts, at = np.cumsum(counts), [], 0
    while at < len(counts):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + BATCH_IDS, side="right")))
        data, ends = model.decode_texts(ids[done:total[to - 1]], counts[at:to])
        parts.append(pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(
            np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)).cast(pa.string()))
        at = to
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def encode(docs: DataFrame, vocabulary: str, keep: list[str], decoded: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs(text, ...)`` with ``ids`` (array of int).

    ``decoded`` adds what :func:`decode` would give, in the same pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [*keep, "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cached_model(Bpe, shared.value)
        for batch in batches:
            for sub in sub_batches(batch, "_text", BATCH_BYTES):
                ids, counts = model.words.encode_texts(sub.column("_text"))
                lists = pa.ListArray.from_buffers(
                    pa.list_(pa.int32()), len(counts), [None, _offsets(np.cumsum(counts))],
                    children=[pa.array(ids.view(np.int32))])
                texts = [_decode(model, ids, counts)] if decoded else []
                yield pa.RecordBatch.from_arrays(
                    [*(sub.column(c) for c in keep), lists, *texts], names=names)

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return map_batches(rows, run, schema_of(docs, keep) + "ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``encoded(ids, ...)`` with ``decoded``: tokens joined by spaces.

    Null ids count as none.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cached_model(Bpe, shared.value)
        for batch in batches:
            ids = batch.column("_ids")
            texts = _decode(model, np.asarray(ids.flatten()), np.diff(np.asarray(ids.offsets, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), texts], names=[*keep, "decoded"])

    rows = encoded.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias("_ids"))
    return map_batches(rows, run, schema_of(encoded, keep) + "decoded string")
