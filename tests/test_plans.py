"""Plans at scale: hot keys are split, stored state stays in place, scans are few."""

import re
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from entailer.functions import vocab as V
from entailer.operators import closure, fixpoint, fused, rules_owl as O, sameas as S
from entailer.operators.graph import Graph
from entailer.operators.joins import measure
from entailer.plans.materialize import materialize_owl, materialize_rdfs

ROWS = 60_000


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    ex = df._jdf.queryExecution()
    df.collect()
    return ex.executedPlan().toString()


@pytest.fixture()
def skew(spark):
    """Small thresholds, so that a third of a small table on one key counts as skewed."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, key):
    """``(key, value)``: a third of the rows share one key."""
    n = F.col("id")
    data = spark.range(ROWS, numPartitions=16).select(
        F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), n)).alias(key),
        F.concat(F.lit("v"), n, F.lit("-padding-padding")).alias("v"))
    return fixpoint.pin(data)


def is_split(df):
    return "skew=true" in executed(df)


def test_hot_group_is_split_in_owl1_and_owl2(skew):
    t = hot(skew, "k").select(F.col("k").alias("s"), F.lit("p").alias("p"), F.col("v").alias("o"))
    props = measure(skew.createDataFrame([("p",)], "prop string"))
    assert is_split(O.owl1(t, props, distinct=False))
    back = t.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    assert is_split(O.owl2(back, props, distinct=False))


def test_hot_node_is_split_in_the_star_steps(skew):
    t = hot(skew, "k")
    low = t.select(F.col("v").alias("u"), F.col("k").alias("v"))
    assert is_split(S._large_star(low))
    high = t.select(F.col("k").alias("u"), F.concat(F.lit("a"), F.col("v")).alias("v"))
    assert is_split(S._small_star(high))


def test_hot_node_is_split_in_restrictions(skew):
    t = hot(skew, "node")
    edges = t.select("node", F.lit("p").alias("prop"), F.lit("in").alias("dir"), F.col("v").alias("other"))
    typed = fixpoint.pin(t.select("node").distinct().select(
        "node", F.lit("p").alias("prop"), F.lit("in").alias("dir"), F.lit("C").alias("x")))
    assert is_split(fused.apply_restrictions(edges, typed))


@pytest.mark.parametrize("partitions", ["4", "16", "200"])
def test_known_facts_are_read_in_place(spark, partitions):
    """Aligned with the buckets, whatever the session's shuffle partitions are."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select(*[F.col("id").cast("string").alias(c) for c in "spo"])
        store = fixpoint.FactStore(spark, size_bytes=fixpoint.SMALL_BYTES * 2)
        store.add(df)
        plan = executed(store.new(df.union(df), store.upto(0)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("== Initial Plan ==")[0]
    assert "Bucketed: true" in final
    assert len(re.findall(r"\bExchange ", final)) == 1  # the candidates only


def test_store_is_dealt_out_anew_when_it_outgrows_its_buckets(spark):
    df = spark.range(500).select(*[F.col("id").cast("string").alias(c) for c in "spo"])
    store = fixpoint.FactStore(spark)
    assert store.buckets == 1
    store.add(df.where("s < '3'"))
    store.add(df.where("s >= '3'"), size_bytes=10 * 1024 * 1024 * 1024)
    assert store.buckets > 50
    assert rows(store.all()) == rows(df) and rows(store.upto(0)) == rows(df.where("s < '3'"))


def test_long_chain_has_constant_scans(spark):
    for n in (10, 50):
        chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(n)], "s string, o string")
        out = closure.transitive_closure(chain)
        assert out.count() == n * (n + 1) // 2
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1


def test_has_value_joins_on_predicate_and_value(spark):
    facts = spark.createDataFrame([("u", "p", "w"), ("v", "p", "z")], "s string, p string, o string")
    table = measure(spark.createDataFrame([("p", "w", "C")], "p string, o string, x string"))
    df = fused.apply_value_rules(facts, table)
    assert rows(df) == {("u", V.RDF_TYPE, "C")}
    join = next(x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "HashJoin" in x)
    assert re.search(r"HashJoin \[p#\d+, o#\d+\]", join)


@pytest.mark.parametrize("output", ["derived", "all"])
def test_rdfs_scans_the_instances_once(spark, output, tmp_dir):
    data = [("a", "ex:p", "b"), ("a", V.RDF_TYPE, "C"), ("b", "ex:isA", "C")]
    spark.createDataFrame(data, "s string, p string, o string").write.mode("overwrite").parquet(tmp_dir + "/abox")
    abox = spark.read.parquet(tmp_dir + "/abox")
    tbox = spark.createDataFrame([
        ("ex:p", V.RDFS_SUBPROPERTY_OF, "ex:q"), ("ex:q", V.RDFS_DOMAIN, "C"), ("ex:q", V.RDFS_RANGE, "D"),
        ("C", V.RDFS_SUBCLASS_OF, "E"), ("ex:isA", V.RDFS_SUBPROPERTY_OF, V.RDF_TYPE)],
        "s string, p string, o string")
    out = materialize_rdfs(Graph(abox=abox, tbox=tbox), output=output).abox
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet .*Location:[^\n]*" + re.escape(tmp_dir), plan)) == 1
    want = {("a", "ex:q", "b"), ("a", V.RDF_TYPE, "C"), ("a", V.RDF_TYPE, "E"), ("b", V.RDF_TYPE, "D"),
            ("b", V.RDF_TYPE, "C"), ("b", V.RDF_TYPE, "E")}
    assert rows(out) == want | (set(data) if output == "all" else set())


def test_state_is_gone_after_its_scope(spark):
    """No table and no folder is left of a call once its scope ends."""
    import os
    root = fixpoint.ensure_checkpoint_dir(spark).removeprefix("file:")
    os.makedirs(root, exist_ok=True)
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("entailer_")}
    before = set(os.listdir(root)), tables()
    abox = spark.createDataFrame([("a", "ex:n", "b"), ("b", "ex:n", "c")], "s string, p string, o string")
    tbox = spark.createDataFrame([("ex:n", V.RDF_TYPE, V.OWL_TRANSITIVE_PROPERTY)],
                                 "s string, p string, o string")
    with fixpoint.state_scope(spark):
        out = materialize_owl(Graph(abox=abox, tbox=tbox), transitive=True, same_as="clusters").abox
        assert ("a", "ex:n", "c") in rows(out)
        assert set(os.listdir(root)) > before[0]
    assert (set(os.listdir(root)), tables()) == before


def _graph_of_chains(spark):
    abox = [(f"a{i}", "p", f"a{i + 1}") for i in range(40)] + [("a0", "q", "a7"), ("a3", V.RDF_TYPE, "C")]
    tbox = [("p", V.RDF_TYPE, V.OWL_TRANSITIVE_PROPERTY), ("p", V.RDFS_SUBPROPERTY_OF, "q"),
            ("q", V.RDFS_RANGE, "C"), ("C", V.RDFS_SUBCLASS_OF, "D")]
    return Graph(*(spark.createDataFrame(t, "s string, p string, o string") for t in (abox, tbox)))


@pytest.mark.parametrize("limit", [None, 0, 64 << 20])
def test_candidates_hashed_or_sorted_give_the_same_facts(spark, monkeypatch, limit):
    """New facts of a round: by the sorted anti-join, and with stored candidates beyond and below the bound."""
    graph = _graph_of_chains(spark)
    if limit is not None:
        monkeypatch.setattr(fixpoint, "HASHED_FROM", 0)
        monkeypatch.setattr(fixpoint, "HASHED_BYTES", limit)
    got = materialize_owl(graph, transitive=True).abox
    pairs = {(f"a{i}", f"a{j}") for i in range(41) for j in range(i + 1, 41)}
    want = {(s, p, o) for s, o in pairs for p in "pq"} | {("a0", "q", "a7")}
    want |= {(f"a{i}", V.RDF_TYPE, c) for i in range(1, 41) for c in "CD"}
    assert got.count() == len(want) and rows(got) == want


def test_rounds_leave_neither_shuffles_nor_the_stored_input_behind(spark):
    """State is read from its own files: what was shuffled or pinned to write it is gone by then."""
    import os

    before = list(fixpoint._state.get(spark.sparkContext.applicationId, []))
    df = spark.range(1000).selectExpr("cast(id as string) s", "'p' p", "'o' o")
    with fixpoint.pinned(df) as held:
        path = held.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert held.count() == 1000 and os.path.isdir(path)
    assert not os.path.exists(path)
    assert fixpoint._state.get(spark.sparkContext.applicationId, []) == before
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [f.getPath() for f in disk.localDirs()]
    shuffles = lambda: {f for d in folders for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}
    had = shuffles()
    kept = fixpoint.pin(df.repartition(4, "s"))
    for _ in range(100):  # removal is asynchronous
        if not shuffles() - had:
            break
        time.sleep(0.1)
    assert not shuffles() - had and kept.count() == 1000
    assert spark.conf.get(fixpoint.SHUFFLE_CLEANUP, "false") == "false"
