"""Sources, sinks, vocabulary and the regression cases of SURVEY §2.8."""

import os

import pytest
from conftest import rows, write_lines

from entailer.functions import vocab as V
from entailer.operators import closure, sameas as S
from entailer.operators.graph import Graph, relation, split_graph
from entailer.plans.materialize import materialize_owl, materialize_rdfs
from entailer.sources.triples import (
    load_graph,
    normalise_vocab,
    parse_lines,
    read_graph,
    read_triples,
    write_graph,
)

TYPE = V.RDF_TYPE


def test_tokens_and_nt_and_rejects(spark, tmp_dir):
    """short/empty lines are rejects; `nt` keeps literals whole."""
    path = write_lines(tmp_dir, "d1.in", ["s p", "", '<a> <b> "x y z" .'])
    t, rej = read_triples(spark, path, "tokens", with_rejects=True)
    assert rows(t) == {("<a>", "<b>", '"x')}
    assert rej.count() == 2
    t, rej = read_triples(spark, path, "nt", with_rejects=True)
    assert rows(t) == {("<a>", "<b>", '"x y z"')}
    assert rej.count() == 2


def test_normalise_vocab(spark):
    df = spark.createDataFrame([("a", "rdf:type", "owl:Thing"), ("p", "rdfs:domain", "ex:C")],
                               "s string, p string, o string")
    assert rows(normalise_vocab(df)) == {
        ("a", TYPE, "<http://www.w3.org/2002/07/owl#Thing>"),
        ("p", V.RDFS_DOMAIN, "ex:C")}


def test_split_graph(spark):
    df = spark.createDataFrame([
        ("a", "ex:p", "b"), ("p", V.RDFS_DOMAIN, "C"), ("p", TYPE, V.OWL_SYMMETRIC_PROPERTY),
        ("x", TYPE, "C")], "s string, p string, o string")
    g = split_graph(df)
    assert rows(g.abox) == {("a", "ex:p", "b"), ("x", TYPE, "C")}
    assert rows(g.tbox) == {("p", V.RDFS_DOMAIN, "C"), ("p", TYPE, V.OWL_SYMMETRIC_PROPERTY)}


def test_sink_source_round_trip(spark, tmp_dir):
    """D3: what the sink writes, the source reads back (nt and parquet)."""
    path = write_lines(tmp_dir, "g.in", ['<a> <p> "lit with spaces" .', "<a> rdf:type <C> .",
                                         "<C> rdfs:subClassOf <D> ."])
    g = load_graph(spark, path, fmt="nt")
    for fmt in ("nt", "parquet"):
        out = os.path.join(tmp_dir, "out-" + fmt)
        write_graph(g, out, fmt=fmt, n=2)
        back = read_graph(spark, out, fmt=fmt)
        assert rows(back.abox) == rows(g.abox) and rows(back.tbox) == rows(g.tbox)


def test_closure_duplicates_do_not_stop_early(spark):
    """Duplicated input lines still give the full closure."""
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("b", "c"), ("c", "d")],
                              "s string, o string")
    assert rows(closure.transitive_closure(e)) == {
        ("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "d"), ("a", "d")}


def test_closure_cycle_terminates(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a")], "s string, o string")
    for method in ("linear", "doubling"):
        assert rows(closure.transitive_closure(e, method=method)) == {
            ("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")}


def test_clusters_long_chain(spark):
    """A chain a-b-...-h ends flat, every member pointing at a."""
    names = "abcdefgh"
    pairs = spark.createDataFrame([(names[i + 1], names[i]) for i in range(7)], "a string, b string")
    assert rows(S.same_as_clusters(pairs)) == {(c, "a") for c in names[1:]}


def _tiny_owl_graph(spark):
    abox = spark.createDataFrame([
        ("o1", "ex:hasPart", "p1"), ("p1", TYPE, "ex:Eco"), ("o1", "ex:placedBy", "c1"),
        ("c1", "ex:name", "n"), ("o2", "ex:hasPart", "p2"), ("o2", TYPE, "ex:Filled"),
    ], "s string, p string, o string")
    tbox = spark.createDataFrame([
        ("ex:EcoOrder", "owl:someValuesFrom", "ex:Eco"), ("ex:EcoOrder", "owl:onProperty", "ex:hasPart"),
        ("ex:EcoOrder", "rdfs:subClassOf", "ex:Discount"),
        ("ex:Discount", "owl:hasValue", "ex:yes"), ("ex:Discount", "owl:onProperty", "ex:discounted"),
        ("ex:discounted", "rdfs:subPropertyOf", "ex:flagged"),
        ("ex:placedBy", "owl:inverseOf", "ex:placed"), ("ex:placed", "rdfs:domain", "ex:Buyer"),
        ("ex:Filled", "owl:allValuesFrom", "ex:FP"), ("ex:Filled", "owl:onProperty", "ex:hasPart"),
        ("ex:FP", "rdfs:subClassOf", "ex:Ship"),
        ("ex:key", "rdf:type", "owl:InverseFunctionalProperty"),
    ], "s string, p string, o string")
    return Graph(abox=normalise_vocab(abox), tbox=normalise_vocab(tbox))


@pytest.fixture(scope="module")
def tiny_owl(spark):
    """The tiny graph's OWL materialisation, computed once for the module."""
    m = materialize_owl(_tiny_owl_graph(spark))
    return rows(m.abox), rows(m.tbox)


def test_owl_chains_reach_fixpoint(tiny_owl):
    """15 -> 9 -> 14b -> 7, domain on the inverse, 16 -> 9."""
    out = tiny_owl[0]
    for fact in [("o1", TYPE, "ex:EcoOrder"), ("o1", TYPE, "ex:Discount"),
                 ("o1", "ex:discounted", "ex:yes"), ("o1", "ex:flagged", "ex:yes"),
                 ("c1", "ex:placed", "o1"), ("c1", TYPE, "ex:Buyer"),
                 ("p2", TYPE, "ex:FP"), ("p2", TYPE, "ex:Ship")]:
        assert fact in out, fact


def test_owl_schema_output_keeps_ifp_class(tiny_owl):
    """Inverse-functional properties are written with their own class."""
    tb = tiny_owl[1]
    assert ("ex:key", TYPE, V.OWL_INVERSE_FUNCTIONAL_PROPERTY) in tb
    assert ("ex:placed", V.OWL_INVERSE_OF, "ex:placedBy") in tb


def test_rdfs_one_pass_outputs(spark):
    g = _tiny_owl_graph(spark)
    derived = rows(materialize_rdfs(g).abox)
    assert ("c1", TYPE, "ex:Buyer") not in derived  # needs OWL 8 first
    every = rows(materialize_rdfs(g, output="all").abox)
    assert derived <= every and rows(g.abox) <= every
    sc = rows(relation(materialize_rdfs(g).tbox, V.RDFS_SUBCLASS_OF))
    assert ("ex:EcoOrder", "ex:Discount") in sc


def test_null_triples_are_dropped_and_fixpoint_terminates(spark):
    abox = spark.createDataFrame([("a", "ex:p", None), (None, "ex:p", "b"), ("a", "ex:p", "b")],
                                 "s string, p string, o string")
    tbox = spark.createDataFrame([("ex:p", V.RDFS_DOMAIN, "ex:C")], "s string, p string, o string")
    out = rows(materialize_owl(Graph(abox=abox, tbox=tbox)).abox)
    assert out == {("a", "ex:p", "b"), ("a", TYPE, "ex:C")}


def test_nt_sink_keeps_awkward_terms(spark, tmp_dir):
    """Line breaks, tabs, backslashes and spaces survive the text round trip."""
    data = [("a b", "p", "x\ny"), ("s", "p\tq", "tab\there"), ("\\n", "p", "back\\slash \\u0020"),
            ("s", "p", " lead"), ("s", "p", "trail "), ("#s", "p", "ends ."), ("s", "p", "dot."),
            ("s", "p", "\r\f\x0b"), ("s", "p", "plain text")]
    df = spark.createDataFrame(data, "s string, p string, o string")
    out = os.path.join(tmp_dir, "awkward")
    write_graph(Graph(abox=df, tbox=df.limit(0)), out)
    back, rejects = read_triples(spark, out + "/instance", "nt", with_rejects=True)
    assert rows(back) == set(data)
    assert rejects.count() == 0


def test_unicode_line_breaks_survive(spark, tmp_dir):
    """U+0085, U+2028 and U+2029 end no line: escaped by the sink, read raw as well."""
    data = [("s", "p", f"a{c}b") for c in "\x85\u2028\u2029"] + [
        ("s", "p", f"ends{c}") for c in "\x85\u2028\u2029"] + [
        ("s", "p", "\u2028"), ("s\u2029", "p\x85", "."), ("s", "p", "\\u2028 \\u0085")]
    df = spark.createDataFrame(data, "s string, p string, o string")
    out = os.path.join(tmp_dir, "breaks")
    write_graph(Graph(abox=df, tbox=df.limit(0)), out)
    back = read_graph(spark, out)
    assert rows(back.abox) == set(data) and back.rejects.count() == 0
    raw = spark.createDataFrame([(f'<s> <p> "x{c}y{c}" .',) for c in "\x85\u2028\u2029"]
                                + [("s p o\u2028",)], "value string")
    triples, rejects = parse_lines(raw, "nt")
    assert rejects.count() == 0
    assert rows(triples) == {("<s>", "<p>", f'"x{c}y{c}"') for c in "\x85\u2028\u2029"} | {("s", "p", "o\u2028")}


def test_read_graph_returns_rejects(spark, tmp_dir):
    """Triples with an empty object come back as rejects, in no other form."""
    df = spark.createDataFrame([("s", "p", ""), ("s", "p", "o")], "s string, p string, o string")
    for fmt, n in (("nt", 2), ("parquet", 0)):
        out = os.path.join(tmp_dir, "empty-" + fmt)
        write_graph(Graph(abox=df, tbox=df), out, fmt=fmt)
        back = read_graph(spark, out, fmt=fmt)
        assert back.rejects.count() == n
        assert rows(back.abox) == ({("s", "p", "o")} if n else rows(df))


def test_write_graph_refuses_to_replace(spark, tmp_dir):
    g = Graph(abox=spark.createDataFrame([("a", "p", "b")], "s string, p string, o string"),
              tbox=spark.createDataFrame([], "s string, p string, o string"))
    out = os.path.join(tmp_dir, "once")
    write_graph(g, out)
    with pytest.raises(Exception, match="(?i)exist"):
        write_graph(g, out)
    write_graph(g, out, mode="overwrite")


def test_load_graph_returns_rejects(spark, tmp_dir):
    a = write_lines(tmp_dir, "a.in", ["<a> <p> <b> .", "too short"])
    t = write_lines(tmp_dir, "t.in", ["<p> rdfs:domain <C> .", "x"])
    g = load_graph(spark, a, t, fmt="nt")
    assert rows(g.abox) == {("<a>", "<p>", "<b>")}
    assert rows(g.rejects) == {("too short",), ("x",)}
    with pytest.raises(ValueError, match="no triples"):
        load_graph(spark, a, t, fmt="nt", fail_on_rejects=True)


def test_subproperties_of_type_and_same_as(spark):
    """Conclusions that are rdf:type or owl:sameAs triples feed every rule."""
    abox = spark.createDataFrame([("x", "ex:isA", "C"), ("x", "ex:aka", "y"), ("y", "ex:p", "z")],
                                 "s string, p string, o string")
    tbox = spark.createDataFrame([
        ("ex:isA", V.RDFS_SUBPROPERTY_OF, TYPE), ("ex:aka", V.RDFS_SUBPROPERTY_OF, V.OWL_SAME_AS),
        ("C", V.RDFS_SUBCLASS_OF, "D")], "s string, p string, o string")
    g = Graph(abox=abox, tbox=tbox)
    for out in (rows(materialize_rdfs(g).abox), rows(materialize_owl(g).abox)):
        assert {("x", TYPE, "C"), ("x", TYPE, "D"), ("x", V.OWL_SAME_AS, "y")} <= out
    merged = rows(materialize_owl(g, same_as="clusters").abox)
    assert ("x", "ex:p", "z") in merged and ("y", V.OWL_SAME_AS, "x") in merged


def test_terms_outside_clusters_stay(spark):
    """A term in no cluster stands for itself, as subject and as object."""
    facts = spark.createDataFrame([("m", "p", "out"), ("out", "p", "m"), ("out", "p", "else")],
                                  "s string, p string, o string")
    clusters = spark.createDataFrame([("m", "id")], "member string, id string")
    assert rows(S.owl11(facts, clusters)) == {
        ("m", "p", "out"), ("out", "p", "m"), ("out", "p", "else"), ("id", "p", "out"), ("out", "p", "id")}
