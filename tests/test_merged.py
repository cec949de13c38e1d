"""Equality inside the fixpoint against naive closures with full substitution."""

import random

from conftest import rows
from entailer.functions import vocab as V
from entailer.operators.graph import Graph
from entailer.operators.joins import measure
from entailer.operators.merging import Forest
from entailer.plans.merged import materialize_owl_merged

TYPE, SAME = V.RDF_TYPE, V.OWL_SAME_AS
TRIPLES = "s string, p string, o string"


def restrictions(tbox, pred):
    return [(v, q, w) for v, p, w in tbox if p == pred for v2, p2, q in tbox
            if p2 == V.OWL_ON_PROPERTY and v2 == v]


def kind(tbox, cls):
    return {s for s, p, o in tbox if p == TYPE and o == cls}


def naive(abox, tbox):
    """Everything the rules give, with every substitution spelled out."""
    facts = set(abox)
    rel = lambda pred: [(s, o) for s, p, o in tbox if p == pred]
    inverse = rel(V.OWL_INVERSE_OF) + [(b, a) for a, b in rel(V.OWL_INVERSE_OF)]
    has, some, only = (restrictions(tbox, p) for p in (V.OWL_HAS_VALUE, V.OWL_SOME_VALUES_FROM, V.OWL_ALL_VALUES_FROM))
    fp, ifp, sym, trans = (kind(tbox, c) for c in (V.OWL_FUNCTIONAL_PROPERTY, V.OWL_INVERSE_FUNCTIONAL_PROPERTY,
                                                   V.OWL_SYMMETRIC_PROPERTY, V.OWL_TRANSITIVE_PROPERTY))
    while True:
        new = set()
        same = {}
        for s, p, o in facts:
            if p == SAME:
                same.setdefault(s, set()).add(o)
        by_sp, by_po = {}, {}
        for s, p, o in facts:
            by_sp.setdefault((s, p), set()).add(o)
            by_po.setdefault((p, o), set()).add(s)
        for s, p, o in facts:
            new |= {(s, b, o) for a, b in rel(V.RDFS_SUBPROPERTY_OF) if a == p}
            new |= {(s, TYPE, c) for a, c in rel(V.RDFS_DOMAIN) if a == p}
            new |= {(o, TYPE, c) for a, c in rel(V.RDFS_RANGE) if a == p}
            new |= {(o, b, s) for a, b in inverse if a == p}
            new |= {(s, TYPE, v) for v, q, w in has if (q, w) == (p, o)}
            if p in sym or p == SAME:
                new.add((o, p, s))
            if p in trans or p == SAME:
                new |= {(s, p, x) for x in by_sp.get((o, p), ())}
            if p in fp:
                new |= {(o, SAME, x) for x in by_sp[s, p] if x != o}
            if p in ifp:
                new |= {(s, SAME, x) for x in by_po[p, o] if x != s}
            if p == TYPE:
                new |= {(s, TYPE, c) for a, c in rel(V.RDFS_SUBCLASS_OF) if a == o}
                new |= {(s, q, w) for v, q, w in has if v == o}
                new |= {(u, TYPE, v) for v, q, w in some if w == o for u in by_po.get((q, s), ())}
                new |= {(x, TYPE, w) for v, q, w in only if v == o for x in by_sp.get((s, q), ())}
            new |= {(s2, p, o2) for s2 in same.get(s, set()) | {s} for o2 in same.get(o, set()) | {o}}
        if new <= facts:
            return facts
        facts |= new


def canonical(facts):
    cluster = {}
    for s, p, o in facts:
        if p == SAME:
            cluster.setdefault(s, set()).add(o)
    low = {t: min(c) for t, c in cluster.items()}
    out = {(low.get(s, s), p, low.get(o, o)) for s, p, o in facts if p != SAME}
    return out | {(t, SAME, m) for t, m in low.items() if t != m}


def run(spark, abox, tbox, **options):
    df = lambda t: spark.createDataFrame(sorted(t), TRIPLES)
    return rows(materialize_owl_merged(Graph(abox=df(abox), tbox=df(tbox)), **options).abox)


def test_chain_of_rules_through_merged_terms(spark):
    """OWL 2 merges, 11 rewrites, 15 types through the merged term, 14b and 1 merge again."""
    tbox = {("key", TYPE, V.OWL_INVERSE_FUNCTIONAL_PROPERTY), ("prize", TYPE, V.OWL_FUNCTIONAL_PROPERTY),
            ("R", V.OWL_SOME_VALUES_FROM, "Good"), ("R", V.OWL_ON_PROPERTY, "sees"),
            ("R", V.RDFS_SUBCLASS_OF, "W"), ("W", V.OWL_HAS_VALUE, "zz"), ("W", V.OWL_ON_PROPERTY, "prize"),
            ("by", TYPE, V.OWL_FUNCTIONAL_PROPERTY)}
    abox = {("d1", "key", "k"), ("d2", "key", "k"), ("d2", TYPE, "Good"), ("u", "sees", "d1"),
            ("u", "prize", "p1"), ("p1", "by", "x"), ("zz", "by", "y"), ("t", "prize", "p1")}
    got = run(spark, abox, tbox)
    assert {("u", TYPE, "R"), ("zz", SAME, "p1"), ("y", SAME, "x"), ("d2", SAME, "d1"), ("t", TYPE, "W")} <= got
    assert got == canonical(naive(abox, tbox))


def random_graph(r, tag):
    """A small graph whose instances, classes and values may be merged."""
    name = lambda kind, n: f"{tag}{kind}{r.randrange(n)}"
    inst, prop, cls = (lambda: name("i", 7)), (lambda: name("p", 4)), (lambda: name("C", 4))
    tbox = set()
    for _ in range(r.randrange(3, 9)):
        tbox.add(r.choice([
            lambda: (prop(), TYPE, r.choice(V.PROPERTY_CLASSES)), lambda: (prop(), TYPE, V.OWL_FUNCTIONAL_PROPERTY),
            lambda: (prop(), V.RDFS_DOMAIN, cls()), lambda: (prop(), V.RDFS_RANGE, cls()),
            lambda: (cls(), V.RDFS_SUBCLASS_OF, cls()), lambda: (prop(), V.RDFS_SUBPROPERTY_OF, prop()),
            lambda: (prop(), V.OWL_INVERSE_OF, prop()), lambda: (prop(), V.RDFS_SUBPROPERTY_OF, SAME),
            lambda: (SAME, V.RDFS_SUBPROPERTY_OF, prop())])())
    for _ in range(r.randrange(3)):
        v = cls()
        pred = r.choice([V.OWL_HAS_VALUE, V.OWL_SOME_VALUES_FROM, V.OWL_ALL_VALUES_FROM])
        tbox |= {(v, pred, inst() if pred == V.OWL_HAS_VALUE else cls()), (v, V.OWL_ON_PROPERTY, prop())}
    abox = set()
    for _ in range(r.randrange(4, 11)):
        abox.add(r.choice([lambda: (inst(), prop(), inst()), lambda: (inst(), TYPE, cls()),
                           lambda: (inst(), SAME, inst()), lambda: (cls(), SAME, cls()),
                           lambda: (inst(), prop(), inst())])())
    return abox, tbox


def test_random_graphs(spark):
    """Many small graphs at once, kept apart by their names; classes are merged too."""
    r = random.Random(1)
    abox, tbox, want = set(), set(), set()
    for g in range(80):
        a, t = random_graph(r, f"g{g}_")
        t = {x for x in t if SAME not in (x[0], x[2])}
        a |= {(f"g{g}_i0", f"g{g}_p0", f"g{g}_i1")}
        abox |= a
        tbox |= t
        want |= canonical(naive(a, t))
    assert run(spark, abox, tbox, transitive=True) == want


def test_rules_about_same_as(spark):
    r = random.Random(100)
    abox, tbox = random_graph(r, "g")
    tbox |= {(SAME, V.RDFS_SUBPROPERTY_OF, "gp0"), ("gp1", V.RDFS_SUBPROPERTY_OF, SAME), (SAME, V.RDFS_DOMAIN, "gC3")}
    abox |= {("gi0", "gp1", "gi1"), ("gi2", SAME, "gi3")}
    assert run(spark, abox, tbox) == canonical(naive(abox, {t for t in tbox if t[2] != V.OWL_TRANSITIVE_PROPERTY}))


def test_forest_grows_by_the_clusters_that_links_touch(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "a string, b string")
    f = Forest()
    assert rows(f.absorb(pairs(("b", "a"), ("d", "c"), ("f", "e"))).df) == {("b", "a"), ("d", "c"), ("f", "e")}
    assert f.absorb(pairs(("b", "a"), ("a", "b"))) is None
    assert rows(f.absorb(pairs(("d", "b"))).df) == {("c", "a")}  # only ids of touched clusters change
    assert rows(f.rows.df) == {("b", "a"), ("c", "a"), ("d", "a"), ("f", "e")}


def test_hot_merges_beyond_the_broadcast_bound(spark):
    """The same result where no side may be broadcast."""
    tbox = {("key", TYPE, V.OWL_INVERSE_FUNCTIONAL_PROPERTY), ("C", V.RDFS_SUBCLASS_OF, "D")}
    abox = {(f"d{i:03}", "key", "hot") for i in range(60)} | {("d059", TYPE, "C"), ("x", "of", "d030")}
    spark.conf.set("entailer.broadcast.maxBytes", "1")
    try:
        got = run(spark, abox, tbox)
    finally:
        spark.conf.unset("entailer.broadcast.maxBytes")
    want = {(f"d{i:03}", SAME, "d000") for i in range(1, 60)}
    want |= {("d000", "key", "hot"), ("d000", TYPE, "C"), ("d000", TYPE, "D"), ("x", "of", "d000")}
    assert got == want


def test_empty_and_null_triples(spark):
    assert run(spark, set(), {("C", V.RDFS_SUBCLASS_OF, "D")}) == set()
    df = spark.createDataFrame([(None, SAME, "a"), ("a", SAME, None), ("a", "p", "b")], TRIPLES)
    got = materialize_owl_merged(Graph(abox=df, tbox=spark.createDataFrame([], TRIPLES))).abox
    assert rows(got) == {("a", "p", "b")}


def test_expansion_on_demand(spark, monkeypatch):
    """The twenty substitutions of one triple between two clusters; sized first, in blocks."""
    import pytest
    from entailer.operators import merging, sameas

    pairs = [("v", "w"), ("w", "u"), ("u", "x"), ("a", "x"), ("d", "c"), ("d", "f"), ("g", "d")]
    clusters = sameas.same_as_clusters(spark.createDataFrame(pairs, "a string, b string"))
    facts = spark.createDataFrame([("a", "p", "c"), ("z", "p", "z"), ("z", "q", "a")], TRIPLES)
    twenty = {(s, "p", o) for s in "auvwx" for o in "cdfg"}
    more = {("z", "p", "z")} | {("z", "q", o) for o in "auvwx"}
    for block in (1000, 2):
        monkeypatch.setattr(merging, "EXPANSION_BLOCK", block)
        asked = spark.createDataFrame([("g",)], "term string")
        assert rows(merging.expanded(facts, clusters, asked)) == twenty
        got = merging.expanded(facts, clusters)
        assert got.count() == 26 and rows(got) == twenty | more
    with pytest.raises(ValueError, match="fewer"):
        merging.expanded(facts, clusters, max_rows=25)


def test_owl11_spells_out_every_substitution(spark):
    """The fixture's twenty triples, terms outside clusters, and no sameAs triple."""
    from entailer.operators import sameas

    pairs = [("v", "w"), ("w", "u"), ("u", "x"), ("a", "x"), ("d", "c"), ("d", "f"), ("g", "d")]
    clusters = sameas.same_as_clusters(spark.createDataFrame(pairs, "a string, b string"))
    facts = spark.createDataFrame([("u", "p", "d"), ("v", "p", "g"), ("z", "p", "z"), ("z", "q", "a"),
                                   ("v", SAME, "w")], TRIPLES)
    got = sameas.substituted(facts, clusters)
    want = {(s, "p", o) for s in "auvwx" for o in "cdfg"} | {("z", "p", "z")} | {("z", "q", o) for o in "auvwx"}
    assert got.count() == 26 and rows(got) == want
    assert rows(sameas.substituted(facts, clusters.limit(0))) == {
        ("u", "p", "d"), ("v", "p", "g"), ("z", "p", "z"), ("z", "q", "a")}


def test_owl11_query_lists_more_than_canonical_triples(spark, tmp_path):
    """Two documents with one text: each has the other's source, by either name."""
    import duckdb
    from entailer.plans.catalog import owl11

    src = "/root/testdata/sf0.001"
    for name in ("customer", "supplier", "part", "orders", "lineitem", "conversations", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{src}/{name}.parquet")
    duckdb.sql(f"copy (select * from (values (1::bigint, 't', 'en', 'x'), (2, 't', 'en', 'y')) d(doc_id, text, lang, source)) "
               f"to '{tmp_path}/documents.parquet' (format parquet)")
    got = {(r["s"], r["p"], r["o"]) for r in owl11(spark, str(tmp_path)).collect() if "source_" in r["p"]}
    assert got == {(f"ex:doc{i}", f"ex:source_{x}", f"ex:{x}") for i in (1, 2) for x in "xy"}


def test_measured_sides_only(spark):
    """A forest side is broadcast only after it was measured."""
    f = Forest()
    f.absorb(spark.createDataFrame([("b", "a")], "a string, b string"))
    assert f.rows.rows == 1 and f.rows.broadcast == measure(f.rows.df).broadcast
