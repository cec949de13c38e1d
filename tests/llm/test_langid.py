"""Op 1: held-out accuracy, and distances against plain code."""

import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entailer.llm import langid
from entailer.llm.queries import op1_language_id
from tests.llm.helpers import DOC_SCHEMA, as_table, awkward_rows, docs, records, with_clashes

SF = "/root/testdata/sf0.001"


def grams(text):
    count = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        padded = "\x01" + word + "\x01"
        count.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1)
                     if (g := padded[i:i + n]) != "\x01" and (n < 3 or g[1] != "\x01"))
    return count


def top(count, k):
    order = sorted(count, key=lambda g: (-count[g], len(g), g))[:k]
    return {g: i for i, g in enumerate(order)}


def brute(rows, texts, k):
    profiles = {}
    for lang in sorted({r[2] for r in rows if r[2] is not None and r[1] is not None}):
        profiles[lang] = top(sum((grams(r[1]) for r in rows if r[2] == lang), Counter()), k)
    out = []
    for t in texts:
        own = top(grams(t), k)
        if not own or not profiles:
            out.append("und")
            continue
        dist = {lang: sum(abs(p[g] - i) if g in p else k for g, i in own.items()) for lang, p in profiles.items()}
        out.append(min(dist, key=lambda x: (dist[x], x)))
    return out


@pytest.mark.parametrize("k", [5, 300])
def test_against_plain_code(spark, k):
    rows = awkward_rows()
    for df in (docs(spark), with_clashes(docs(spark))):
        profiles = langid.train_profiles(df, k)
        keyed = df.select("doc_id", "text", F.col("text").alias("t"))
        got = records(langid.identify(keyed, profiles, ["doc_id", "t"], k), "doc_id", "t", "lang_pred")
        want = brute(rows, [r[1] for r in rows], k)
        assert got == sorted(((r[0], r[1], w) for r, w in zip(rows, want)), key=repr)


def test_scores_and_undetermined(spark):
    df = langid.identify(docs(spark), langid.train_profiles(docs(spark)), ["doc_id", "text"])
    for r in df.collect():
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_nothing_learned_and_empty(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    got = langid.identify(docs(spark), langid.train_profiles(empty), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in got} == {"und"} and len(got) == len(awkward_rows())
    assert langid.identify(empty, langid.train_profiles(docs(spark)), ["doc_id"]).count() == 0


def test_held_out_flag(spark, tmp_path):
    sf = as_table(str(tmp_path), documents=docs(spark))
    for r in op1_language_id(spark, sf).collect():
        crc = None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        assert r["held_out"] == (crc is not None and crc % 4 == 2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_held_out_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    held = [r for r in op1_language_id(spark, SF).collect() if r["held_out"] and langs[r["doc_id"]]]
    right = sum(r["lang_pred"] == langs[r["doc_id"]] for r in held)
    assert len(held) > 20 and right >= 0.97 * len(held)


def test_profiles_are_cut_to_their_length_before_the_shuffle(spark):
    plan = langid.train_profiles(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
