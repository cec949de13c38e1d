"""Registered queries of this subpackage: each applies its operator to the whole
table with production parameters and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from entailer.llm import (
    bpe,
    chat,
    decontam,
    exact,
    langid,
    licenses,
    repair,
    repetition,
    simhash,
    substrings,
    tokenio,
    urls,
    whitening,
)
from entailer.llm.common import scratch, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 1

# A conversation whose texts hold the template's own control strings.
CONTROL_CONVERSATION = -7
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def vocabulary():
    return bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    profiles = langid.train_profiles(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), profiles, ["doc_id", "held_out"])


def op2_token_shards(spark, sf_dir):
    path = scratch(spark, "token-shards")
    tokenio.write_ids(table(spark, sf_dir, "documents"), vocabulary(), END_ID, path)
    return tokenio.read_ids(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(CONTROL_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(CONTROL_TEXT).alias("text"))
    parsed = chat.parse_conversations(chat.format_conversations(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op4_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_repetition_rules(spark, sf_dir):
    return repetition.repetition_rules(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op6_bpe_round_trip(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), ["doc_id"], decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_benchmark_leaks(spark, sf_dir):
    """One row for each (document, benchmark item) found; other documents are clean."""
    found = decontam.find_items(table(spark, sf_dir, "documents"),
                                table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.inline("matches"))


def op8_url_filter(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages")).drop("score")


def op9_simhash_near_copies(spark, sf_dir):
    found = simhash.near_copies(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op10_substring_dedup(spark, sf_dir):
    return substrings.drop_repeats(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def damaged(rows):
    """Conversations with the faults that op 11 repairs, by a checksum of (conversation, turn)."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = (F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(plain("text"), "[.!?]", ""))
            .otherwise(plain("text")))
    role = F.when(fault == 4, F.lit("user")).otherwise(plain("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(fault == 3, F.lit(2)).otherwise(F.lit(1))))
    return rows.where(fault != 0).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = damaged(rows)
    found = repair.repair_conversations(turns)
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).try_cast("long").alias("gaps"))
    lines = repair.digests(found.turns)
    out = rows.select("conv_id").distinct()
    for part in (gaps, found.conversations, lines):
        part = part.withColumnRenamed("conv_id", "_id")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    nought = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "conv_id", *[nought(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark, sf_dir):
    return exact.exact_copies(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_shards": op2_token_shards,
    "op3_chat_format": op3_chat_format,
    "op4_license_scan": op4_license_scan,
    "op5_repetition_rules": op5_repetition_rules,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_url_filter": op8_url_filter,
    "op9_simhash_near_copies": op9_simhash_near_copies,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}
