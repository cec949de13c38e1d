"""Ranks by ranges, pages of member lists and the term dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from entailer.functions import vocab as V
from entailer.operators import sameas as S
from entailer.operators.dictionary import TermDictionary, code_width
from entailer.operators.graph import Graph
from entailer.operators.ranks import ranked
from entailer.plans.materialize import materialize_owl, materialize_owl_encoded

TRIPLES = "s string, p string, o string"


def graph(spark, abox, tbox=()):
    return Graph(abox=spark.createDataFrame(list(abox), TRIPLES), tbox=spark.createDataFrame(list(tbox), TRIPLES))


def test_ranks_within_groups(spark):
    pick = random.Random(5)
    data = [(g, v) for g, n in (("hot", 700), ("b", 40), ("c", 1), (None, 9)) for v in range(n)]
    data += [("b", 7), ("b", 7)]
    pick.shuffle(data)
    df = spark.createDataFrame(data, "g string, v int").repartition(5)
    got = [(r["g"], r["v"], r["rank"]) for r in ranked(df, ["v"], within=["g"]).collect()]
    want = []
    for g in {g for g, _ in data}:
        want += [(g, v, i) for i, v in enumerate(sorted(v for h, v in data if h == g))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    everything = sorted((r["v"], r["rank"]) for r in ranked(df, ["v"]).collect())
    assert everything == [(v, i) for i, v in enumerate(sorted(v for _, v in data))]


def test_ranks_of_no_rows(spark):
    assert ranked(spark.createDataFrame([], "v int"), ["v"]).collect() == []


def test_a_hot_group_is_numbered_in_several_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").cast("string").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = df.repartitionByRange("g", "v").select(F.spark_partition_id().alias("t")).distinct().count()
        got = ranked(df, ["v"], within=["g"])
        assert parts == 8 and got.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()[:] == (0, 19_999, 20_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_cluster_pages(spark, size):
    groups = {"a": [f"a{i:03}" for i in range(100)], "b": ["b1"], "c": [f"c{i}" for i in range(7)]}
    pairs = spark.createDataFrame([(m, g) for g, ms in groups.items() for m in ms], "a string, b string")
    got = {(r["id"], r["page"]): r["members"] for r in S.cluster_pages(S.same_as_clusters(pairs), size).collect()}
    want = {}
    for g, ms in groups.items():
        whole = sorted([g, *ms])
        want |= {(g, i // size): whole[i:i + size] for i in range(0, len(whole), size)}
    assert got == want
    with pytest.raises(ValueError):
        S.cluster_pages(pairs, 0)


@pytest.mark.parametrize("size", [2, 1000])
def test_cluster_members_lists_every_member(spark, size):
    groups = {"a": [f"a{i}" for i in range(6)], "b": ["b1"]}
    pairs = spark.createDataFrame([(m, g) for g, ms in groups.items() for m in ms], "a string, b string")
    got = S.cluster_members(S.same_as_clusters(pairs), size).collect()
    assert {(r["id"], r["n_members"], r["max_member"]) for r in got} == {("a", 7, "a5"), ("b", 2, "b1")}
    lists = {g: [m for r in sorted(got, key=lambda r: r["page"]) if r["id"] == g for m in r["members"]] for g in groups}
    assert lists == {g: sorted([g, *ms]) for g, ms in groups.items()}
    assert all(len(r["members"]) <= size for r in got)


def test_pages_of_no_clusters(spark):
    assert S.cluster_pages(spark.createDataFrame([], "member string, id string")).collect() == []


@pytest.mark.parametrize("terms, width", [(0, 1), (1, 1), (36, 1), (37, 2), (1296, 2), (1297, 3)])
def test_code_width(terms, width):
    assert code_width(terms) == width


def test_codes_are_distinct_sort_as_terms_and_leave_the_vocabulary(spark):
    odd = ["", "0", "00", "Z", "z", "é", "𝒳", "<x>", '"a b"@en', "_:b0", "a" * 5000, "ÿ", "0A"]
    terms = odd + [f"http://example.org/long/term/{i}" for i in range(1500)]
    g = graph(spark, [(t, V.RDF_TYPE, "ex:C") for t in terms] + [("0", "ex:p", "0"), ("0", "ex:p", "0")],
              [("ex:p", V.RDFS_SUBPROPERTY_OF, "ex:q"), ("ex:C", V.RDFS_SUBCLASS_OF, "ex:D")])
    d = TermDictionary.of(g)
    codes = {r["term"]: r["id"] for r in d.terms.df.collect()}
    every = {*terms, "ex:C", "ex:D", "ex:p", "ex:q"}
    assert set(codes) == every and len(set(codes.values())) == len(every)
    assert {len(c) for c in codes.values()} == {3}
    by_bytes = sorted(every, key=lambda t: t.encode())
    assert [codes[t] for t in by_bytes] == sorted(codes.values())
    assert {"ex:p", "ex:q"} <= {r["term"] for r in d.predicates.df.collect()}
    coded = d.encode(g)
    assert {p for (p,) in rows(coded.abox, "p")} == {V.RDF_TYPE, codes["ex:p"]}
    back = d.decode(coded)
    for a, b in ((g.abox, back.abox), (g.tbox, back.tbox)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_nulls_and_empty_graphs_pass_through(spark):
    g = graph(spark, [(None, "ex:p", "ex:a"), ("ex:a", None, None)])
    d = TermDictionary.of(g)
    assert sorted(map(tuple, d.decode(d.encode(g)).abox.collect()), key=repr) == sorted(
        [(None, "ex:p", "ex:a"), ("ex:a", None, None)], key=repr)
    none = graph(spark, [])
    assert materialize_owl_encoded(none).abox.collect() == []


@pytest.mark.parametrize("broadcast", [True, False])
def test_encoded_materialisation_equals_the_plain_one(spark, broadcast):
    pick = random.Random(11)
    node = [f"http://example.org/node/{pick.random()}" for _ in range(25)]
    props = [f"ex:p{i}" for i in range(5)]
    abox = {(pick.choice(node), pick.choice(props), pick.choice(node)) for _ in range(90)}
    abox |= {(pick.choice(node), V.RDF_TYPE, f"ex:C{pick.randrange(4)}") for _ in range(20)}
    abox |= {(node[0], V.OWL_SAME_AS, node[1]), (node[1], V.OWL_SAME_AS, node[2])}
    tbox = {("ex:p0", V.RDFS_SUBPROPERTY_OF, "ex:p1"), ("ex:p1", V.RDFS_DOMAIN, "ex:C0"), ("ex:p2", V.RDFS_RANGE, "ex:C1"),
            ("ex:C0", V.RDFS_SUBCLASS_OF, "ex:C2"), ("ex:p2", V.OWL_INVERSE_OF, "ex:new"),
            ("ex:p3", V.RDF_TYPE, V.OWL_FUNCTIONAL_PROPERTY), ("ex:p4", V.RDF_TYPE, V.OWL_TRANSITIVE_PROPERTY),
            ("ex:R", V.OWL_ON_PROPERTY, "ex:p4"), ("ex:R", V.OWL_SOME_VALUES_FROM, "ex:C1"),
            ("ex:H", V.OWL_ON_PROPERTY, "ex:fresh"), ("ex:H", V.OWL_HAS_VALUE, "ex:v"),
            ("ex:C1", V.RDFS_SUBCLASS_OF, "ex:H")}
    g = graph(spark, abox, tbox)
    if not broadcast:
        spark.conf.set("entailer.broadcast.maxBytes", "0")
    try:
        plain, coded = (f(g, transitive=True, same_as="clusters") for f in (materialize_owl, materialize_owl_encoded))
        assert rows(plain.abox) == rows(coded.abox) and rows(plain.tbox) == rows(coded.tbox)
        assert coded.abox.count() == len(rows(coded.abox)) > len(abox)
    finally:
        spark.conf.unset("entailer.broadcast.maxBytes")
