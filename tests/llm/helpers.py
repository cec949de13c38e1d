"""Small documents with every awkward case, and digests to compare with."""

import hashlib
import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = ["alpha", "beta", "Gamma", "delta,", "été", "naïve.", "the", "of", "MIT", "License", "x1", "#", "***"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def awkward_rows():
    """Null columns, empty and long texts, exact and near copies, repeated rows, ties."""
    long = prose(1, 6000)
    base = prose(2, 120)
    near = base.replace("alpha", "omega", 1)
    passage = prose(3, 60)
    rows = [
        (0, None, "en", "a", None), (1, "", None, None, 0), (2, "  \n\t ", "en", "a", 5),
        (3, "one", "en", "a", 3), (4, "two words", "de", "b", 9), (5, base, "en", "a", len(base)),
        (6, base, "en", "b", len(base)), (7, near, "en", "c", len(near)), (8, long, "fr", "a", len(long)),
        (9, prose(4, 30) + " " + passage + " " + prose(5, 30), "de", "a", 1),
        (10, prose(6, 20) + "\n" + passage + "\n" + prose(7, 45), "de", "a", 1),
        (11, "a " * 200, "en", "a", 400), (12, passage + " " + prose(8, 3) + " " + passage, "es", "a", 1),
        (5, base, "en", "a", len(base)), (13, prose(9, 90), None, None, None), (None, prose(10, 70), "en", "a", 1),
        (None, "no id", None, None, None), (14, "\x00\x1c\u00a0 日本語 العربية 👍🏽 e\u0301", "en", "a", 1),
    ]
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, DOC_SCHEMA)


def with_clashes(df):
    """The table with extra columns that clash with names the operators use."""
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("x").alias(c) for c in (
        "words", "fp", "m", "s", "at", "n_words", "kept", "ids", "_text", "matches", "score", "g", "rid")])


def as_table(folder, **tables):
    """Writes tables to a folder as a scale-factor directory."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def records(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
