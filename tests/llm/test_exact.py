"""Op 13: against plain grouping; the code, the exchange and colliding fingerprints."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from entailer.llm import exact
from entailer.llm.oracle import ORACLE_SQL
from entailer.llm.queries import op13_exact_dedup
from tests.llm.helpers import DOC_SCHEMA, as_table, awkward_rows, docs, prose, records, with_clashes

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def expected(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows]
    groups = {}
    for i, t in enumerate(norm):
        groups.setdefault(t, []).append(i)
    out = []
    for t, members in groups.items():
        first = min(members, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
        out += [(rows[i][0], rows[first][0], len(members), i == first,
                 hashlib.sha256(t.encode()).hexdigest()) for i in members]
    return sorted(out, key=repr)


def more_rows():
    rows = awkward_rows()
    rows += [(1000 + i, "hot  text\n" + " " * (i % 3) + "here", None, None, None) for i in range(400)]
    rows += [(2000 + i, prose(i, 15), None, None, None) for i in range(300)]
    rows += [(3000 + i, prose(i, 15).replace(" ", "\t "), None, None, None) for i in range(0, 300, 7)]
    rows += [(4000, "hot text here", None, None, None), (4001, "", None, None, None), (4002, " ", "x", "y", 1),
             (-5, prose(3, 15), None, None, None), (4003, "long " * 200_000, "a", "b", 1), (4004, "long\n" * 200_000, "a", "b", 1)]
    return rows


@pytest.mark.parametrize("partitions", [1, 9])
def test_groups(spark, tmp_path, partitions):
    rows = more_rows()
    for df in (docs(spark, rows), with_clashes(docs(spark, rows))):
        sf = as_table(str(tmp_path), documents=df.repartition(partitions))
        assert records(op13_exact_dedup(spark, sf), *COLUMNS) == expected(rows)


def test_matches_the_sql(spark, tmp_path):
    rows = [r for r in more_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    sf = as_table(str(tmp_path), documents=docs(spark, rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    rel = con.sql(ORACLE_SQL["op13_exact_dedup"])
    assert records(op13_exact_dedup(spark, sf), *rel.columns) == sorted(rel.fetchall(), key=repr)


@pytest.mark.parametrize("n,span", [(1, 1), (1, 1 << 40), (50, 64), (64, 64), (5000, 1 << 44), (3000, 1 << 13)])
def test_golomb_code(n, span):
    values = np.sort(np.random.default_rng(n).choice(min(span, 1 << 20), n, replace=False)).astype(np.uint64)
    if span > 1 << 20:
        values *= np.uint64(span >> 20)
    k, code = exact.golomb_encode(values, span)
    assert (exact.golomb_decode(n, k, code) == values).all()
    if n >= 3000:  # near the information of the set, and far below eight bytes a value
        assert len(code) * 8 < n * (np.log2(span / n) + 2.6)


def test_few_fingerprint_bits_still_give_exact_groups(spark, monkeypatch):
    """Fingerprints that collide make suspects, never groups."""
    class Coarse(exact.Ranges):
        def __init__(self, rows, parallelism):
            self.owner_bits, self.bits = 1, 4

    monkeypatch.setattr(exact, "Ranges", Coarse)
    rows = [(i, prose(i % 80, 6), None, None, None) for i in range(120)]
    assert records(exact.exact_copies(docs(spark, rows)), *COLUMNS) == expected(rows)


def test_stored_texts_stay_in_place(spark):
    """Marks move to the senders' rows; the stored rows are read by bucket."""
    stored = exact.store_in_place(spark.range(5000, numPartitions=4).select(
        F.shiftright("id", 8).alias("unit"), (F.col("id") % 256).alias("idx"), F.xxhash64("id").alias("fp"),
        F.lit("text").alias("norm")), 8, "unit")
    marks = exact.suspects(stored, exact.Ranges(5000, 4))
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # messages by owner, bitmaps by sender
    assert marks.count() == 20


def test_empty_table(spark):
    assert exact.exact_copies(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
