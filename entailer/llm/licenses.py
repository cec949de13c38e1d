"""License scan by diagonal voting (native: Spark expressions and joins only).

Every text gives the rolling hashes of all its word ``K``-grams; they are joined
to the (position, hash) rows of the templates. A match of text word ``i`` with
template word ``j`` votes for the diagonal ``i - j``. Votes are aggregated per
diagonal, neighbouring diagonals of one template merge (small insertions and
deletions), and spans are verified word by word.

* *Phrases* (the base labels) count where a diagonal holds every gram of the
  phrase: its words stand there consecutively.
* *License texts* (labels of the method) need ``MIN_COVER`` of their grams, each
  counted once however often it votes, on neighbouring diagonals within a span that is
  not much longer than the text.

A hash match only becomes a vote after its words were compared, so spans hold
verified words. Templates are a fixed list, which bounds the broadcast side.

Defined cases: a null text has no words; fewer than ``K`` words match nothing;
every row of the table gives one result row, repeated ids included; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from entailer.llm.common import lower_az
from entailer.operators.fixpoint import pin

K = 2
GAP = 3  # neighbouring diagonals: at most this many words inserted or deleted
MIN_COVER = 0.6  # share of a license text's grams that must vote
MAX_GRAMS = 62  # of one template
MAX_STRETCH = 1.5  # longest span, in lengths of the license text
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that give the base labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
# Opening words of well-known license grants and notices.
LICENSE_TEXTS = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files", "mit"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
]


def template_grams(spark: SparkSession, phrases=PHRASES, texts=LICENSE_TEXTS) -> DataFrame:
    """``(h, tid, label, base, at, n_grams, w1, w2)``: one row per template gram."""
    rows = []  # a template's grams are marked in the bits of a long
    for tid, (text, label) in enumerate([*phrases, *texts]):
        words = re.findall(WORD, text)
        if len(words) - K + 1 > MAX_GRAMS:
            raise ValueError(f"a template has over {MAX_GRAMS} grams: split it: {text!r}")
        for at in range(len(words) - K + 1):
            rows.append((tid, label, tid < len(phrases), at, len(words) - K + 1, *words[at:at + K]))
    grams = spark.createDataFrame(
        rows, "tid int, label string, base boolean, at int, n_grams int, w1 string, w2 string")
    return grams.withColumn("h", F.xxhash64("w1", "w2"))


def votes(docs: DataFrame, phrases=PHRASES, texts=LICENSE_TEXTS) -> DataFrame:
    """One row per (document row, template, diagonal) with its votes.

    Every document also keeps one row without a template (``tid`` null), so
    that documents without a match stay in the result.
    """
    words = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        F.regexp_extract_all(lower_az(F.coalesce(F.col("text").cast("string"), F.lit(""))),
                             F.lit(WORD), F.lit(0)).alias("words"))
    n = F.size("words")
    # Position 0 holds the document's own mark: a hash no template has.
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - K + 1, F.lit(0))), lambda i: F.when(
        i > 0, F.xxhash64(F.get("words", i - 1), F.get("words", i))))
    rows = words.select("rid", "doc_id", n.cast("long").alias("n_words"), "words",
                        F.posexplode(hashes).alias("i", "h"))
    grams = F.broadcast(template_grams(docs.sparkSession, phrases, texts))
    hit = (F.get("words", F.col("i") - 1) == F.col("w1")) & (F.get("words", F.col("i")) == F.col("w2"))
    matched = rows.join(grams, "h", "left").where((F.col("i") == 0) | hit)
    return matched.select(
        "rid", "doc_id", "n_words", "tid", "label", "base", "n_grams",
        (F.col("i") - 1 - F.col("at")).cast("long").alias("diag"), "at").groupBy(
        "rid", "doc_id", "n_words", "tid", "label", "base", "n_grams", "diag").agg(
        F.count("at").alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"),
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("grams"))


def spans(voted: DataFrame) -> DataFrame:
    """Neighbouring diagonals of one template merged to spans (license texts)."""
    by = W.partitionBy("rid", "tid").orderBy("diag")
    new = F.coalesce((F.col("diag") - F.lag("diag").over(by) > GAP).cast("int"), F.lit(1))
    runs = voted.withColumn("run", F.sum(new).over(
        by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return runs.groupBy("rid", "doc_id", "n_words", "tid", "label", "n_grams", "run").agg(
        F.bit_count(F.bit_or("grams")).alias("grams"), F.min(F.col("diag") + F.col("lo")).alias("first"),
        F.max(F.col("diag") + F.col("hi") + K - 1).alias("last")).withColumn(
        "cover", F.col("grams") / F.col("n_grams")).where(
        (F.col("cover") >= MIN_COVER)
        & (F.col("last") - F.col("first") + 1 <= MAX_STRETCH * (F.col("n_grams") + K - 1)))


def scan_licenses(docs: DataFrame, phrases=PHRASES, texts=LICENSE_TEXTS) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per document row::

        doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score

    ``n_base`` places of base phrases, the first and last of their start
    words, both label lists (distinct, sorted, comma-joined), and ``score``:
    1 with a base phrase, else the largest cover of a license text, else 0.
    """
    voted = pin(votes(docs, phrases, texts))  # read three times below
    places = voted.where(F.col("base") & (F.col("votes") == F.col("n_grams"))).select(
        "rid", "doc_id", "n_words", "label", F.lit(True).alias("base"),
        F.col("diag").alias("place"), F.lit(1.0).alias("cover"))
    found = spans(voted.where(~F.col("base"))).select(
        "rid", "doc_id", "n_words", "label", F.lit(False).alias("base"),
        F.lit(None).cast("long").alias("place"), "cover")
    marks = voted.where(F.col("tid").isNull()).select(
        "rid", "doc_id", "n_words", F.lit(None).cast("string").alias("label"),
        F.lit(False).alias("base"), F.lit(None).cast("long").alias("place"), F.lit(0.0).alias("cover"))
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return marks.unionByName(places).unionByName(found).groupBy("rid", "doc_id", "n_words").agg(
        F.count("place").alias("n_base"), F.min("place").alias("first_word"),
        F.max("place").alias("last_word"),
        join(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        join("label").alias("labels"), F.round(F.max("cover"), 6).alias("score")).drop("rid")
