"""The pipeline's stages against brute-force versions, and its SQL queries."""

import os

import duckdb
import pytest

import corpus_pipeline as P
from entailer.llm.oracle import ORACLE_SQL
from entailer.llm.queries import QUERIES
from tests.llm import test_decontam, test_repetition, test_simhash, test_substrings
from tests.llm.helpers import DOC_SCHEMA, as_table, awkward_rows, docs, prose, records, with_clashes

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    item = test_decontam.ITEMS[0]
    passage = prose(90, 45)
    rows = awkward_rows() + [
        (40, prose(41, 80) + " " + item + " " + prose(42, 20), "en", "a", 1),
        (41, prose(43, 80) + " " + passage, "en", "a", 7), (42, passage + " " + prose(44, 80), "en", None, None)]
    sf = as_table(str(tmp_path), documents=with_clashes(docs(spark, rows)),
                  benchmark=spark.createDataFrame([(9, item)], "item_id long, text string"))
    seen = spark.read.parquet(sf + "/documents.parquet")

    def stage(i, df):
        out = P.STAGES[i][1](spark, df, sf)
        path = str(tmp_path / f"stage{i}")
        out.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    # Quality rules.
    first = stage(0, seen)
    assert first.columns == P.COLUMNS
    ok = []
    for r in rows:
        n, _, _, _, rep, cov, longest = test_repetition.brute(r[1])
        if n >= 50 and 100 * rep <= 50 * n and cov <= 0.3 * n and longest <= 100:
            ok.append(r)
    assert records(first) == sorted(ok, key=repr)
    # One row of each component, with its smallest id.
    second = stage(1, first)
    fps = [test_simhash.fingerprint(r[1]) for r in ok]
    low = test_simhash.components(ok, fps)
    want = {}
    for r, c in zip(ok, low):
        if r[0] == c:
            want.setdefault(c, r)
    assert records(second) == sorted(want.values(), key=repr)
    # Repeated passages.
    third = stage(2, second)
    cut = {r[0]: r for r in test_substrings.brute(list(want.values()), 35)}
    for r in third.collect():
        _, n, gone, text = cut[r["doc_id"]]
        old = want[r["doc_id"]]
        assert r["text"] == (text if gone else old[1])
        assert r["n_chars"] == (len(text) if gone else old[4])
    assert third.count() == len(want) and any(c[2] for c in cut.values())
    # Benchmark items.
    fourth = stage(3, third)
    assert {r["doc_id"] for r in third.collect()} - {r["doc_id"] for r in fourth.collect()} == {40}
    assert stage(4, fourth).count() == fourth.count()


def test_empty_documents(spark, tmp_path):
    sf = as_table(str(tmp_path), documents=spark.createDataFrame([], DOC_SCHEMA),
                  benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert P.run(spark, sf).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert records(got, *cols) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
