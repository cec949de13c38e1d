"""Op 7: edited passages are found, exact distances, clean texts stay."""

import random

import numpy as np
import pyarrow as pa

from entailer.llm import decontam
from tests.llm.helpers import DOC_SCHEMA, awkward_rows, docs, records, with_clashes

R = random.Random(5)
VOCAB = ["".join(R.choice("abcdeghilmnorstu") for _ in range(R.randrange(2, 9))) for _ in range(4000)]
COMMON = ["the", "of", "and", "to", "in"]


def text(n, r):
    return [r.choice(COMMON) if r.random() < 0.35 else r.choice(VOCAB) for _ in range(n)]


ITEMS = [" ".join(text(R.randrange(15, 60), R)) for _ in range(60)]


def edited(words, k, r):
    words = list(words)
    for _ in range(k):
        op, at = r.randrange(3), r.randrange(len(words))
        if op == 0:
            words[at] = r.choice(VOCAB)
        elif op == 1:
            words.insert(at, r.choice(VOCAB))
        else:
            del words[at]
    return words


def distance(item, words):
    """Smallest edit distance of the item to any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(words):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_recall_at_every_allowed_share_of_edits():
    items = decontam.Items(list(range(60)), ITEMS)
    r = random.Random(9)
    for share in (0.0, 0.1, 0.2):
        texts, want = [], []
        for _ in range(200):
            q = r.randrange(60)
            item = ITEMS[q].split()
            body = edited(item, int(share * len(item)), r)
            words = text(r.randrange(50), r) + body + text(r.randrange(50), r)
            texts.append(" ".join(words).upper() if r.random() < 0.3 else ", ".join(words))
            want.append((q, distance(item, words)))
        found = decontam.find_matches(items, pa.array(texts))
        hits = sum(any(m["item_id"] == q and m["distance"] == d for m in ms) for ms, (q, d) in zip(found, want))
        assert hits >= (200 if share == 0 else 190), (share, hits)


def test_recall_at_every_size():
    """From the smallest items up: exact copies inside a text, and the largest allowed share of edits."""
    r = random.Random(17)
    for m in range(decontam.MIN_ITEM_WORDS, 31):
        entries = [text(m, r) for _ in range(150)]
        items = decontam.Items(list(range(150)), [" ".join(e) for e in entries])
        for k in (0, int(decontam.allowed(m))):
            bodies = [text(30, r) + edited(e, k, r) + text(30, r) for e in entries]
            found = decontam.find_matches(items, pa.array([" ".join(b) for b in bodies]))
            hits = sum(any(x["item_id"] == q and x["distance"] == distance(entries[q], b) for x in ms)
                       for q, (b, ms) in enumerate(zip(bodies, found)))
            assert hits >= (150 if k == 0 or m < decontam.SHORT_WORDS else 143), (m, k, hits)


def test_common_pieces_are_verified_in_parts(monkeypatch):
    entries = [f"what is the {a} {b}" for a, b in zip(VOCAB[:300], VOCAB[300:600])]
    items = decontam.Items(list(range(300)), entries)
    texts = pa.array(["so " + ", and ".join(entries), "what is the " * 50, entries[7]])
    want = decontam.find_matches(items, texts)
    assert [m["item_id"] for m in want[0]] == list(range(300)) and not want[1]
    assert all(m["distance"] == 0 for m in want[0]) and want[2][0]["item_id"] == 7
    monkeypatch.setattr(decontam, "PROPOSALS", 100)
    assert decontam.find_matches(items, texts) == want


def test_every_report_is_exact():
    items = decontam.Items(list(range(60)), ITEMS)
    r = random.Random(11)
    texts = [" ".join(text(100, r) + edited(ITEMS[q].split(), 5, r) + text(40, r)) for q in range(40)]
    for t, ms in zip(texts, decontam.find_matches(items, pa.array(texts))):
        words = t.split()
        for m in ms:
            item = ITEMS[m["item_id"]].split()
            assert m["distance"] == distance(item, words) <= decontam.allowed(len(item))
            assert distance(item, words[m["first_word"]:m["last_word"] + 1]) == m["distance"]


def test_clean_texts_have_no_match():
    items = decontam.Items(list(range(60)), ITEMS)
    r = random.Random(13)
    assert not any(decontam.find_matches(items, pa.array([" ".join(text(400, r)) for _ in range(60)])))


def test_cgk_equal_sequences_embed_equally():
    words = np.arange(1, 60, dtype=np.uint64)
    twice = np.concatenate([words, words])
    for rnd in range(decontam.ROUNDS):
        a, b = decontam.cgk_keys(twice, np.array([3, 62]), np.array([40, 99]), rnd)
        assert a == b


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_awkward_documents_and_items(spark):
    rows = awkward_rows() + [(30, "x " + ITEMS[0] + " y", None, None, None), (30, "x " + ITEMS[0] + " y", None, None, None),
                             (31, ITEMS[1] + " " + ITEMS[1] + " " + ITEMS[2], None, None, None)]
    items = [(0, ITEMS[0]), (1, ITEMS[1]), (2, ITEMS[2]), (3, None), (4, ""), (5, "one"), (None, ITEMS[3]), (1, ITEMS[1])]
    for df in (docs(spark, rows), with_clashes(docs(spark, rows))):
        found = decontam.find_items(df, bench(spark, items), ["doc_id"])
        assert found.count() == len(rows)
        got = {(r["doc_id"], m["item_id"], m["distance"], m["first_word"]) for r in found.collect() for m in r["matches"]}
        n1 = len(ITEMS[1].split())
        assert got == {(30, 0, 0, 1), (31, 1, 0, 0), (31, 2, 0, 2 * n1)}


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 20)
    rows = [(i, t, None, None, None) for i, t in enumerate(ITEMS)]
    found = decontam.find_items(docs(spark, rows), bench(spark, list(enumerate(ITEMS))), ["doc_id", "text"])
    assert sorted((r["doc_id"], m["item_id"]) for r in found.collect() for m in r["matches"]) == [(i, i) for i in range(60)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC_SCHEMA)
    assert decontam.find_items(none, bench(spark, [(0, ITEMS[0])]), ["doc_id"]).count() == 0
    got = records(decontam.find_items(docs(spark), bench(spark, []), ["doc_id"]), "matches")
    assert got == [([],)] * len(awkward_rows())
