"""A triple graph derived from the driver's relational tables.

The instance data (ABox) maps rows of customer, supplier, part, orders,
lineitem, conversations and documents to triples. The schema (TBox) is built
from the tables too -- classes from nation, region and part types, properties
from document sources, languages and roles, restrictions from part types and
order priorities -- plus a fixed set of axioms on top. Terms are CURIEs
(``ex:``, ``rdf:``, ``rdfs:``, ``owl:``); :func:`derived_graph` normalises
them to full IRIs like any other input. Every ABox part grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entailer.operators.fixpoint import union_all
from entailer.operators.graph import Graph
from entailer.sources.triples import prepare

# Fixed schema axioms of the derived graph (s, p, o), as CURIEs.
AXIOMS = [
    ("ex:Part", "rdfs:subClassOf", "ex:Product"),
    ("ex:placedBy", "rdfs:subPropertyOf", "ex:relatedTo"),
    ("ex:relatedTo", "rdfs:subPropertyOf", "ex:linkedTo"),
    ("ex:placedBy", "rdfs:domain", "ex:Order"),
    ("ex:placedBy", "rdfs:range", "ex:Customer"),
    ("ex:hasPart", "rdfs:domain", "ex:Order"),
    ("ex:hasPart", "rdfs:range", "ex:Part"),
    ("ex:placedBy", "owl:inverseOf", "ex:placed"),
    ("ex:placedBy", "owl:inverseOf", "ex:buys"),
    ("ex:boughtWith", "rdf:type", "owl:SymmetricProperty"),
    ("ex:replyTo", "rdf:type", "owl:TransitiveProperty"),
    ("ex:textHash", "rdf:type", "owl:InverseFunctionalProperty"),
    ("ex:firstDoc", "rdf:type", "owl:FunctionalProperty"),
    ("ex:UrgentOrder", "owl:hasValue", "ex:pr_1-URGENT"),
    ("ex:UrgentOrder", "owl:onProperty", "ex:priority"),
    ("ex:OpenOrder", "owl:hasValue", "ex:st_O"),
    ("ex:OpenOrder", "owl:onProperty", "ex:status"),
    ("ex:EconomyOrder", "owl:someValuesFrom", "ex:PT_ECONOMY"),
    ("ex:EconomyOrder", "owl:onProperty", "ex:hasPart"),
    ("ex:EconomyBasket", "owl:someValuesFrom", "ex:PT_ECONOMY"),
    ("ex:EconomyBasket", "owl:onProperty", "ex:boughtWith"),
    ("ex:FilledOrder", "owl:allValuesFrom", "ex:FilledPart"),
    ("ex:FilledOrder", "owl:onProperty", "ex:hasPart"),
    ("ex:EconomyOrder", "rdfs:subClassOf", "ex:DiscountOrder"),
    ("ex:DiscountOrder", "owl:hasValue", "ex:yes"),
    ("ex:DiscountOrder", "owl:onProperty", "ex:discounted"),
    ("ex:discounted", "rdfs:subPropertyOf", "ex:flagged"),
    ("ex:placed", "rdfs:domain", "ex:Buyer"),
    ("ex:Customer", "rdfs:subClassOf", "ex:Agent"),
    ("ex:FilledPart", "rdfs:subClassOf", "ex:Shippable"),
    ("ex:source", "rdfs:subPropertyOf", "ex:provenance"),
    ("ex:provenance", "rdfs:subPropertyOf", "ex:linkedTo"),
]

# Further axioms for equality inside the fixpoint: a review whose document is good
# (perhaps only by an equal document's label) wins; its prize is the winner's, and so on.
MERGE_AXIOMS = [
    ("ex:Awarded", "owl:someValuesFrom", "ex:Quality1"),
    ("ex:Awarded", "owl:onProperty", "ex:reviews"),
    ("ex:Awarded", "rdfs:subClassOf", "ex:Winner"),
    ("ex:Winner", "owl:hasValue", "ex:winner"),
    ("ex:Winner", "owl:onProperty", "ex:award"),
    ("ex:award", "rdf:type", "owl:FunctionalProperty"),
    ("ex:givenBy", "rdf:type", "owl:FunctionalProperty"),
]

# Schema triples per distinct value of a column: (table, column, s, p, o), where
# ``{}`` in a term stands for the value (spaces become underscores).
PER_VALUE = [
    ("part", "p_type", "ex:PT_{}", "rdfs:subClassOf", "ex:Part"),
    ("part", "p_type", "ex:Basket_{}", "owl:someValuesFrom", "ex:PT_{}"),
    ("part", "p_type", "ex:Basket_{}", "owl:onProperty", "ex:hasPart"),
    ("part", "p_type", "ex:Basket_{}", "rdfs:subClassOf", "ex:Basket"),
    ("orders", "o_orderpriority", "ex:PriorityOrder_{}", "owl:hasValue", "ex:pr_{}"),
    ("orders", "o_orderpriority", "ex:PriorityOrder_{}", "owl:onProperty", "ex:priority"),
    ("orders", "o_orderstatus", "ex:StatusOrder_{}", "owl:allValuesFrom", "ex:StatusPart_{}"),
    ("orders", "o_orderstatus", "ex:StatusOrder_{}", "owl:onProperty", "ex:hasPart"),
    ("documents", "source", "ex:source_{}", "rdfs:subPropertyOf", "ex:source"),
    ("documents", "source", "ex:source_{}", "rdf:type", "owl:FunctionalProperty"),
    ("documents", "source", "ex:source_{}", "owl:inverseOf", "ex:holds_{}"),
    ("documents", "lang", "ex:sameLang_{}", "rdf:type", "owl:SymmetricProperty"),
    ("documents", "lang", "ex:hash_{}", "rdf:type", "owl:InverseFunctionalProperty"),
    ("documents", "lang", "ex:hash_{}", "rdfs:subPropertyOf", "ex:textHash"),
    ("conversations", "role", "ex:replyTo_{}", "rdf:type", "owl:TransitiveProperty"),
    ("conversations", "role", "ex:replyTo_{}", "rdfs:subPropertyOf", "ex:replyTo"),
]


def _t(df: DataFrame, s: Column, p: str | Column, o: Column) -> DataFrame:
    p = F.lit(p) if isinstance(p, str) else p
    return df.select(s.alias("s"), p.alias("p"), o.alias("o"))


def _many(df: DataFrame, *triples: tuple[Column, str | Column, Column, Column | None]) -> DataFrame:
    """Several triples per row from one scan: ``(s, p, o, condition)`` each.

    The row is read once and ``explode``d into its triples (shared
    sub-expressions such as a text digest are computed once per row).
    """
    structs = [F.struct(s.alias("s"), (p if isinstance(p, Column) else F.lit(p)).alias("p"),
                        o.alias("o")) for s, p, o, _ in triples]
    items = [st if cond is None else F.when(cond, st) for st, (_, _, _, cond) in zip(structs, triples)]
    return (df.select(F.explode(F.array(*items)).alias("t")).where(F.col("t").isNotNull())
            .select("t.s", "t.p", "t.o"))


def _term(prefix: str, *cols) -> Column:
    return F.concat(F.lit(prefix), *[F.col(c).cast("string") if isinstance(c, str) else c
                                     for c in cols])


def _value(template: str, column: str) -> Column:
    """A term with a column's whole value in place of ``{}``."""
    head, found, tail = template.partition("{}")
    if not found:
        return F.lit(template)
    return F.concat(F.lit(head), F.replace(F.col(column), F.lit(" "), F.lit("_")), F.lit(tail))


def raw_abox(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, supplier, part = read("customer"), read("supplier"), read("part")
    orders, lineitem = read("orders"), read("lineitem")
    conv, docs = read("conversations"), read("documents")
    a, b = lineitem.alias("a"), lineitem.alias("b")
    next_line = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey"))
                       & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1))
    ord_ = _term("ex:ord", "o_orderkey")
    status = F.col("o_orderstatus")
    digest = docs.select("doc_id", "source", _term("ex:h", F.md5(F.col("text"))).alias("h"))
    doc = _term("ex:doc", "doc_id")
    return union_all([
        _t(customer, _term("ex:cust", "c_custkey"), "rdf:type", _term("ex:Nation", "c_nationkey")),
        _t(supplier, _term("ex:supp", "s_suppkey"), "rdf:type", _term("ex:Nation", "s_nationkey")),
        _t(part, _term("ex:part", "p_partkey"), "rdf:type", _term("ex:PT_", "p_type")),
        _many(orders,
              (ord_, "ex:placedBy", _term("ex:cust", "o_custkey"), None),
              (ord_, "ex:priority", _value("ex:pr_{}", "o_orderpriority"), None),
              (ord_, "rdf:type", F.lit("ex:FilledOrder"), status == "F"),
              (ord_, "rdf:type", F.lit("ex:OpenOrder"), status == "O")),
        _t(lineitem, _term("ex:ord", "l_orderkey"), "ex:hasPart", _term("ex:part", "l_partkey")),
        _t(next_line, _term("ex:part", F.col("a.l_partkey").cast("string")), "ex:boughtWith",
           _term("ex:part", F.col("b.l_partkey").cast("string"))),
        _t(conv.where(F.col("turn") > 0),
           _term("ex:conv", "conv_id", F.lit("_"), "turn"), "ex:replyTo",
           _term("ex:conv", "conv_id", F.lit("_"), (F.col("turn") - 1).cast("string"))),
        _many(digest,
              (doc, "ex:textHash", F.col("h"), None),
              (F.col("h"), "ex:firstDoc", doc, None),
              (doc, _value("ex:source_{}", "source"), _value("ex:{}", "source"), None)),
    ])


def raw_tbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation, region = read("nation"), read("region")
    columns = dict.fromkeys((t, c) for t, c, *_ in PER_VALUE)
    # One scan and one distinct per column, then a few triples per value.
    values = [_many(read(t).select(c).distinct(), *[
        (_value(s, c), p, _value(o, c), None) for t2, c2, s, p, o in PER_VALUE if (t2, c2) == (t, c)])
        for t, c in columns]
    axioms = spark.createDataFrame(AXIOMS, "s string, p string, o string")
    return union_all([
        _t(nation, _term("ex:Nation", "n_nationkey"), "rdfs:subClassOf",
           _term("ex:Region", "n_regionkey")),
        _t(region, _term("ex:Region", "r_regionkey"), "rdfs:subClassOf", F.lit("ex:Place")),
        *values,
        axioms,
    ])


def derived_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """ABox and TBox, CURIEs expanded, each deduplicated (graphs are sets)."""
    return Graph(abox=prepare(raw_abox(spark, sf_dir)), tbox=prepare(raw_tbox(spark, sf_dir)))


def merge_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The derived graph with reviews, prizes and labels, whose rules merge terms in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    doc, rev = _term("ex:doc", "doc_id"), _term("ex:rev", "doc_id")
    prize = _value("ex:prize_{}", "source")
    more = union_all([
        _t(labels, doc, "rdf:type", _term("ex:Quality", "quality")),
        _many(docs, (rev, "ex:reviews", doc, None), (rev, "ex:award", prize, None)),
        _t(docs.select("source").distinct(), prize, "ex:givenBy", _value("ex:{}", "source")),
    ])
    axioms = spark.createDataFrame(MERGE_AXIOMS, "s string, p string, o string")
    return Graph(abox=prepare(raw_abox(spark, sf_dir).unionByName(more)),
                 tbox=prepare(raw_tbox(spark, sf_dir).unionByName(axioms)))
