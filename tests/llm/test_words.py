"""Equality of words and lines: texts of regular structure, and hashes that collide."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from entailer.llm import bpe, decontam, repetition, substrings, tokenio, words
from entailer.llm.queries import vocabulary
from tests.llm.helpers import docs, prose, records


def thue_morse(n, a="a", b="b"):
    """``n`` letters in which every power of an odd base cancels out against their swap."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (64, 1024, 2048, 1 << 14)]


def test_regular_words_have_different_hashes():
    texts = pa.array([w for pair in PAIRS for w in pair], pa.string())
    hashes = words.Words(texts, words.SPACE).hashes()
    assert len(set(hashes.tolist())) == len(hashes)


@pytest.mark.parametrize("model", [bpe.Bpe, tokenio.LibraryEncoder])
def test_ids_of_regular_words(model):
    library = Tokenizer.from_str(vocabulary())
    texts = [f"{x} {y}!" for x, y in PAIRS]
    ids, counts = model(vocabulary()).words.encode_texts(pa.array(texts, pa.string()))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_lines_and_repeats_of_regular_words():
    for x, y in PAIRS:
        got = repetition.measure(pa.array([f"{x}\n{y}", f"{x} {x} {x} {x} {y} {y}"], pa.string()))
        assert got["n_dup_lines"].tolist() == [0, 0] and got["n_repeat_words"].tolist() == [0, 4]


def test_passages_that_differ_in_a_regular_word(spark):
    """Neither substring dedup nor decontamination takes one word for the other."""
    x, y = PAIRS[1]
    a, b = prose(70, 30), prose(71, 30)
    rows = [(0, f"{a} {x} {b}", None, None, 0), (1, f"{a} {y} {b}", None, None, 0)]
    assert records(substrings.drop_repeats(docs(spark, rows), ["doc_id"]), "n_removed") == [(0,), (0,)]
    items = spark.createDataFrame([(7, f"{x} {y} {x} {x} {y}")], "item_id long, text string")
    texts = [(0, f"so {y} {x} {y} {y} {x} end", None, None, 0), (1, f"so {x} {y} {x} {x} {y} end", None, None, 0)]
    found = decontam.find_items(docs(spark, texts), items, ["doc_id"]).selectExpr("doc_id", "size(matches) n")
    assert records(found) == [(0, 0), (1, 1)]


def test_colliding_hashes_are_told_apart_by_bytes(monkeypatch):
    texts = ["one two three one", "two", "x" * 5000 + " " + "x" * 4999 + "y one", ""]
    exact = words.Words(pa.array(texts, pa.string()), words.SPACE)
    raw = [exact.data.tobytes()[a:b] for a, b in zip(exact.starts, exact.ends)]
    for fake in (lambda d, s, e: (e - s).astype(np.uint64), lambda d, s, e: np.zeros(len(s), np.uint64)):
        monkeypatch.setattr(words, "range_hashes", fake)
        first, inverse = exact.distinct()
        assert [raw[first[i]] for i in inverse] == raw and len(first) == len(set(raw))
