"""Op 10: removed words against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entailer.llm import substrings
from tests.llm.helpers import DOC_SCHEMA, awkward_rows, docs, prose, records, with_clashes


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i:i + window])] > 1
                for j in range(i, i + window)}
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def random_rows(seed, n, vocabulary, pieces):
    r = random.Random(seed)
    blocks = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(3, 40))) for _ in range(pieces)]
    return [(i, "\n".join(r.choice(blocks) if r.random() < 0.5 else " ".join(
        r.choice(vocabulary) for _ in range(r.randrange(30))) for _ in range(r.randrange(8))), None, None, None)
        for i in range(n)]


@pytest.mark.parametrize("window,kmer", [(35, 8), (5, 2), (3, 3), (8, 1)])
def test_against_brute_force(spark, window, kmer):
    rows = awkward_rows() + random_rows(window, 60, [f"w{i}" for i in range(12)], 6)
    for df in (docs(spark, rows), with_clashes(docs(spark, rows))):
        got = substrings.drop_repeats(df, ["doc_id"], window, kmer)
        assert records(got, "doc_id", "n_words", "n_removed", "kept_text") == brute(rows, window)


def test_common_passage_in_many_contexts(spark):
    """Every document has the same passage between words of its own."""
    passage = prose(77, 50)
    rows = [(i, f"{prose(1000 + i, 40)} {passage} {prose(2000 + i, 30)}", None, None, None) for i in range(80)]
    got = records(substrings.drop_repeats(docs(spark, rows), ["doc_id"]), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == brute(rows, 35) and all(g[2] >= 50 for g in got)


def test_one_id_with_two_texts(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a, None, None, None), (1, b, None, None, None), (2, "x " + a, None, None, None)]
    assert records(substrings.drop_repeats(docs(spark, rows), ["doc_id"]), "doc_id", "n_words", "n_removed",
                   "kept_text") == brute(rows, 35)


@pytest.mark.parametrize("doc_id", [None, 1])
def test_many_texts_under_one_id(spark, doc_id):
    """Texts that share an id (or none) and 23 bits of their hash keep their own spans."""
    mask = (1 << 23) - 1
    long, short = prose(1, 90), prose(2, 36)
    both = spark.createDataFrame([(f"{body} {tail}{i}", body == long) for body, tail in (
        (long, "x"), (short, "y")) for i in range(9000)], "text string, long boolean").withColumn(
        "h", F.xxhash64("text").bitwiseAND(F.lit(mask).cast("long"))).collect()
    first = {r["h"]: r["text"] for r in both if r["long"]}
    pairs = [(first[r["h"]], r["text"]) for r in both if not r["long"] and r["h"] in first]
    assert pairs
    texts = [t for pair in pairs[:1] for t in pair] + [f"other {long}", prose(3, 50)]
    rows = [(doc_id, t, None, None, None) for t in texts]
    got = records(substrings.drop_repeats(docs(spark, rows), ["doc_id"]), "doc_id", "n_words", "n_removed",
                  "kept_text")
    assert got == brute(rows, 35)


def test_untouched_texts_stay_as_they_are(spark):
    rows = [(1, "a  b\n c ", None, None, None), (2, None, None, None, None)]
    got = records(substrings.drop_repeats(docs(spark, rows), ["doc_id"], collapse=False), "doc_id", "kept_text")
    assert got == [(1, "a  b\n c "), (2, None)]


def test_empty_table(spark):
    assert substrings.drop_repeats(spark.createDataFrame([], DOC_SCHEMA), ["doc_id"]).count() == 0
