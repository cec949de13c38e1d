"""Token-id shards in bit planes.

Texts are encoded with the ``tokenizers`` library; an end id closes every
document. Documents are range-partitioned and sorted by id, and each task writes
its ids as *chunks*: whole documents, about ``CHUNK_IDS`` ids. A chunk's ids are
cut into blocks of ``BLOCK`` ids (the last one padded with zeros); a block is
transposed into 32 bit planes, and every plane is compressed with zstandard.
All-zero planes, such as the upper ones of a small vocabulary, take no bytes.

Stored as Parquet, since Spark's writers reach every store and commit whole
tasks only::

    chunks/  shard, chunk, start, n_ids, doc_ids, doc_lengths, plane_sizes, payload
    index/   shard, chunk, start, n_ids, n_docs, first_doc, last_doc

``start`` counts the ids of the shard before the chunk; ``plane_sizes`` holds 32
sizes a block. The index is the same table without contents: a reader finds a
document's chunk in it without touching payloads.

Defined cases: a null text is empty and holds the end id only; null ids come
first; rows with the same id are kept, ordered by a hash of the text; an empty
table writes empty tables and reads back empty; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from entailer.llm.bpe import BATCH_BYTES, CACHE_WORDS, WordCache, cached_model
from entailer.llm.common import map_batches
from entailer.llm.words import SPACE, Words, ranges, sub_batches

BLOCK = 1 << 14
CHUNK_IDS = 1 << 18
PLANES = 32
CACHE_PIECES = 400_000
LEVEL = 3
PRINTABLE = re.compile(rb"[!-~]+")
LETTERS = re.compile(r"[^\W\d_]+")
# Kinds of bytes inside words; the bytes of all other code points count as letters.
LETTER, DIGIT, SIGN, CONTROL = 1, 2, 3, 4
KIND = np.full(256, CONTROL, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[i for i in range(256) if i >= 0x80 or chr(i).isalpha()]] = LETTER
KIND[ord("0"):ord("9") + 1] = DIGIT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed by the file's word pattern

CHUNK_SCHEMA = ("shard int, chunk int, start long, n_ids long, doc_ids array<long>, "
                "doc_lengths array<long>, plane_sizes array<int>, payload binary")


def _cut_contractions(cut: np.ndarray, data: np.ndarray, quotes: np.ndarray,
                      word: np.ndarray, ends: np.ndarray) -> None:
    """Cut after a contraction instead of after its quote."""
    end = ends[word[quotes]]
    for letters in CONTRACTIONS:
        fits = quotes + len(letters) < end
        at, last = quotes[fits], end[fits]
        same = np.ones(len(at), bool)
        for i, letter in enumerate(letters.encode(), 1):
            same &= data[at + i] == letter
        cut[at[same] + 1] = False
        after = at[same] + 1 + len(letters)
        cut[after[after < last[same]]] = True


class Pieces(Words):
    """Parts of a batch's words that the library encodes apart as it does together.

    Texts may be cut at ASCII white space, because this kind of vocabulary drops
    white space between words. Words are cut further where the file's word pattern
    certainly cuts, all words of a batch at once on their bytes: printable ASCII
    words by that pattern, after lower-casing; others between ASCII punctuation and
    runs of letters, if ``sure`` says of every run that it is cut off there. Any
    other word is left whole and in its own case.
    """

    def __init__(self, texts: pa.Array, sure: Callable[[bytes], bool]):
        super().__init__(texts, SPACE)
        if not len(self):
            return
        raw, begin, end = self.data, self.starts, self.ends
        kind = KIND[raw]
        word = np.cumsum(np.bincount(begin, minlength=len(raw)), dtype=np.int64) - 1  # of each byte

        def words_with(bytes_: np.ndarray) -> np.ndarray:
            found = np.zeros(len(begin), bool)
            found[word[np.flatnonzero(bytes_ & self.inside)]] = True
            return found

        quote = raw == ord("'")
        opens = np.zeros(len(raw), bool)  # perhaps an added token
        opens[:-1] = (raw[:-1] == ord("<")) & (raw[1:] == ord("|")) & (word[:-1] == word[1:])
        wide = words_with(raw >= 0x80)
        whole = words_with(opens | (kind == CONTROL)) | wide & words_with(quote | (kind == DIGIT))
        mixed = wide & ~whole & words_with(kind == SIGN)

        self.data = LOWER[raw]
        kept = ranges(begin[wide | whole], (end - begin)[wide | whole])
        self.data[kept] = raw[kept]
        cut = np.empty(len(raw), bool)
        cut[0], cut[1:] = True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        cut[begin] = True
        # A quote after other punctuation belongs to that run; cuts show where it does not.
        quotes = np.flatnonzero(quote & self.inside & cut)
        _cut_contractions(cut, self.data, quotes, word, end)

        def divide(whole: np.ndarray) -> None:
            cut[ranges(begin[whole] + 1, (end - begin)[whole] - 1)] = False
            self.starts = np.flatnonzero(cut & self.inside)
            self.ends = np.minimum(np.append(self.starts[1:], len(raw)), end[word[self.starts]])

        divide(whole)
        runs = np.flatnonzero(mixed[word[self.starts]] & (kind[self.starts] == LETTER))
        spelled = raw.tobytes()
        unsure = [a for a, b in zip(self.starts[runs].tolist(), self.ends[runs].tolist())
                  if not sure(spelled[a:b])]
        if unsure:
            whole[word[unsure]] = True
            divide(whole)
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)

    def vocabulary(self) -> tuple[list[bytes], np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [
            None, pa.py_buffer(offsets), pa.py_buffer(self.data[self.inside])])
        found = pieces.dictionary_encode()
        return found.dictionary.to_pylist(), found.indices.to_numpy()


class Spelling(dict):
    """Letters of pieces as the library's model gets them, for ``str.translate``.

    A letter below ``SIMPLE`` is asked about once, between two others: it must stand in
    one piece with them and be spelled alike beside them. (No letter in this range joins
    one before it into a new letter.) Any other character becomes ``OTHER``.
    """

    OTHER = "\0"
    SIMPLE = 0x530  # Latin, Greek and Cyrillic

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def spelled(self, text: str) -> list[str]:
        text = self.tokenizer.normalizer.normalize_str(text)
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def __missing__(self, code: int) -> str:
        letter = chr(code)
        found = self.spelled(letter) if code < self.SIMPLE and letter.isalpha() else []
        alike = len(found) == 1 and self.spelled(f"a{letter}a") == [f"a{found[0]}a"]
        self[code] = found[0] if alike else self.OTHER
        return self[code]


class LibraryEncoder:
    """Encodes distinct pieces with the library; recent ones are kept.

    The library is asked about every letter beside punctuation, for some turn into a
    letter and a mark, which it joins with the punctuation, and its Unicode version
    decides what a letter is. ASCII pieces are what the library's front end would
    hand to its model, and other letters are spelled as it would, so they go straight
    there; what is left passes through all of the library.
    """

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks use every core already
        self.tokenizer = Tokenizer.from_str(text)
        self.spelling = Spelling(self.tokenizer)
        self.words = WordCache(self.encode_pieces, CACHE_PIECES, lambda texts: Pieces(texts, self.sure))
        self.runs: dict[bytes, bool] = {}
        self.letters: dict[str, bool] = {}

    def cuts(self, letter: str) -> bool:
        """Whether the library cuts between this letter and punctuation on both sides."""
        known = self.letters.get(letter)
        if known is None:
            text = self.tokenizer.normalizer.normalize_str(f"?{letter}?")
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            known = self.letters[letter] = pieces[0][0] == pieces[-1][0] == "?"
        return known

    def sure(self, run: bytes) -> bool:
        """Whether a run is of letters only and cut off from punctuation around it."""
        known = self.runs.get(run)
        if known is None:
            if len(self.runs) > CACHE_WORDS:
                self.runs.clear()
            text = run.decode()
            known = self.runs[run] = bool(LETTERS.fullmatch(text)) and self.cuts(text[0]) and self.cuts(text[-1])
        return known

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        tokenize, spelling = self.tokenizer.model.tokenize, self.spelling
        out: list[list[int]] = []
        rest: list[tuple[int, str]] = []
        for piece in pieces:
            text = piece.decode()
            if PRINTABLE.fullmatch(piece) and b"<|" not in piece:
                out.append([t.id for t in tokenize(text.lower())])
                continue
            spelled = text.translate(spelling)
            if spelling.OTHER in spelled:
                rest.append((len(out), text))
                out.append([])
            else:
                out.append([t.id for t in tokenize(spelled)])
        found = self.tokenizer.encode_batch_fast([text for _, text in rest], add_special_tokens=False)
        for (i, _), encoded in zip(rest, found):
            out[i] = encoded.ids
        return out


def pack_ids(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Ids -> compressed bit planes of all blocks and the size of each plane."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK, "<u4")
    padded[:len(ids)] = ids
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    parts, sizes = [], []
    for block in padded.reshape(blocks, BLOCK):
        used = int(np.bitwise_or.reduce(block))
        for k in range(PLANES):
            plane = np.packbits((block >> np.uint32(k)).astype(np.uint8) & 1) if used >> k & 1 else None
            parts.append(b"" if plane is None else compress(plane))
            sizes.append(len(parts[-1]))
    return b"".join(parts), sizes


def unpack_ids(payload: bytes, sizes: list[int], n_ids: int) -> np.ndarray:
    """The inverse of :func:`pack_ids`."""
    blocks = len(sizes) // PLANES
    out = np.zeros((blocks, BLOCK), "<u4")
    decompress = zstandard.ZstdDecompressor().decompress
    at = 0
    for k, size in enumerate(sizes):
        if size:
            raw = decompress(payload[at:at + size], max_output_size=BLOCK // 8)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8))
            out[k // PLANES] |= bits.astype(np.uint32) << np.uint32(k % PLANES)
            at += size
    return out.reshape(-1)[:n_ids]


def _write_chunks(shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cached_model(LibraryEncoder, shared.value)
        shard = TaskContext.get().partitionId()
        chunk = start = held = 0
        docs: list[int | None] = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids, counts = np.concatenate(parts), np.concatenate(lengths)
            payload, sizes = pack_ids(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()),
                pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int32())), pa.array([payload], pa.binary()),
            ], names=[f.split()[0] for f in CHUNK_SCHEMA.split(", ")])

        for batch in batches:
            for sub in sub_batches(batch, "_text", BATCH_BYTES):
                ids, counts = model.words.encode_texts(sub.column("_text"))
                parts.append(np.insert(ids, np.cumsum(counts), np.uint32(end_id)))
                lengths.append(counts + 1)
                docs += sub.column("doc_id").to_pylist()
                held += len(parts[-1])
                if held >= CHUNK_IDS:
                    yield close()
                    chunk, start, held = chunk + 1, start + held, 0
                    docs, lengths, parts = [], [], []
        if docs:
            yield close()
    return run


def write_ids(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """Encode ``docs(doc_id, text)`` and write chunks and index below ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    order = ["doc_id", F.xxhash64("_text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(
        F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    map_batches(rows, _write_chunks(shared, end_id), CHUNK_SCHEMA).write.option(
        "compression", "uncompressed").parquet(path + "/chunks")
    docs.sparkSession.read.schema(CHUNK_SCHEMA).parquet(path + "/chunks").select(
        "shard", "chunk", "start", "n_ids", F.size("doc_ids").alias("n_docs"),
        F.get("doc_ids", F.lit(0)).alias("first_doc"),
        F.get("doc_ids", F.size("doc_ids") - 1).alias("last_doc")).write.parquet(path + "/index")


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_ids(row["payload"], row["plane_sizes"], row["n_ids"])
            ends = np.cumsum(row["doc_lengths"])
            raw = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(ends),
                [None, pa.py_buffer(np.concatenate([[0], 4 * ends])), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * len(ends), pa.int32()),
                 pa.array(row["doc_ids"], pa.int64()),
                 pa.array(row["start"] + ends - row["doc_lengths"], pa.int64()),
                 pa.array(row["doc_lengths"], pa.int64()), raw.cast(pa.binary())],
                names=["shard", "doc_id", "at", "n_tokens", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``: ids as little-endian unsigned 32-bit bytes.

    ``start`` counts the ids of all documents before; shard sizes come from the
    index and are summed over shards (one row per written partition).
    """
    index = spark.read.parquet(path + "/index")
    sizes = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = map_batches(spark.read.schema(CHUNK_SCHEMA).parquet(path + "/chunks"), 
        _read_chunks, "shard int, doc_id long, at long, n_tokens long, ids binary")
    return rows.join(shards, "shard").select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids")
