"""A training-corpus pipeline over the ``documents`` table.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before kept; all but the last return the columns of ``documents``. Extra columns
of an input are dropped. A null text is an empty text to every stage; empty
tables pass through; the first stage rejects texts without words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entailer.llm import bpe, decontam, repetition, simhash, substrings
from entailer.llm.common import scratch, table
from entailer.operators.fixpoint import pin

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return repetition.repetition_rules(docs, COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows are numbered in a stored table first, so that repeated and null ids
    stay apart; a null id stays only in a group without any other id.
    """
    rows = pin(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    found = simhash.near_copies(rows, ["doc_id", "row"])
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    stay = found.groupBy("cid").agg(first.alias("first")).select("first.row")
    return rows.join(stay, "row", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once; other texts unchanged."""
    kept = substrings.drop_repeats(docs, ["doc_id", "lang", "source", "n_chars"], collapse=False)
    return kept.withColumn("text", F.col("kept_text")).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontam.find_items(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where(F.size("matches") == 0).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a digest of their decoding."""
    text = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    return bpe.encode(docs, text, ["doc_id"], decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

# Fingerprints, edit distances and BPE merges are beyond SQL; the tests compare
# every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stored as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
