"""Registered queries: one per operator, each over the derived graph of a
scale-factor directory. Every callable takes ``(spark, sf_dir)`` and returns
a DataFrame whose columns match the oracle SQL of :mod:`entailer.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entailer.functions import vocab as V
from entailer.functions.terms import term_parts
from entailer.operators import closure, rules_owl as O, rules_rdfs as R, sameas as S
from entailer.operators.fixpoint import new_facts, pin, pinned, union_all
from entailer.operators.joins import measure
from entailer.operators.merging import Forest, expanded
from entailer.operators.reachability import owl4_compact as owl4_labels
from entailer.operators.graph import (
    Graph,
    inverse_pairs,
    properties_of_kind,
    relation,
    restrictions,
    split_abox as split_abox_parts_of,
    split_graph,
    types_of,
)
from entailer.plans.materialize import OwlSchema, materialize_owl, materialize_owl_encoded, materialize_rdfs
from entailer.plans.merged import materialize_owl_merged
from entailer.plans.stored import extend, materialize_owl_at, read_materialized
from entailer.plans.testgraph import derived_graph, merge_graph
from entailer.operators.fixpoint import state_path
from entailer.sources.triples import load_graph, parse_lines, read_graph, write_graph

Query = Callable[[SparkSession, str], DataFrame]


def _closed(tbox: DataFrame, pred: str) -> DataFrame:
    return closure.transitive_closure(relation(tbox, pred))


def normalise_vocab(spark, sf_dir):
    return derived_graph(spark, sf_dir).triples().distinct()


def split_tbox(spark, sf_dir):
    return split_graph(derived_graph(spark, sf_dir).triples().distinct()).tbox


def split_abox(spark, sf_dir):
    return split_graph(derived_graph(spark, sf_dir).triples().distinct()).abox


def split_abox_parts(spark, sf_dir):
    """Asserted triples, types and sameAs pairs (here: the OWL 1/2 links) apart."""
    g = derived_graph(spark, sf_dir)
    links = O.owl2(g.abox, properties_of_kind(g.tbox, V.OWL_INVERSE_FUNCTIONAL_PROPERTY))
    triples, types, sames = split_abox_parts_of(g.abox.unionByName(links))
    part = lambda name, df, s, p, o: df.select(
        F.lit(name).alias("part"), F.col(s).alias("s"), p.alias("p"), F.col(o).alias("o"))
    return union_all([part("triple", triples, "s", F.col("p"), "o"),
                      part("type", types, "s", F.lit(V.RDF_TYPE), "cls"),
                      part("sameAs", sames, "a", F.lit(V.OWL_SAME_AS), "b")])


def _token_lines(spark, sf_dir):
    """Text lines from the orders: some with trailing tokens, some too short, some with gaps."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    line = (F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("<o"), key, F.lit("> <p>")))
            .when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("<o"), key, F.lit(">  <gap>")))
            .otherwise(F.concat_ws(" ", F.concat(F.lit("<o"), key, F.lit(">")), F.lit("<prio>"),
                                   F.col("o_orderpriority"))))
    return orders.select(line.alias("value"))


def parse_tokens(spark, sf_dir):
    return parse_lines(_token_lines(spark, sf_dir), "tokens")[0]


def rejects(spark, sf_dir):
    return parse_lines(_token_lines(spark, sf_dir), "tokens")[1]


def parse_nt(spark, sf_dir):
    """Whole literals: the object keeps its inner spaces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.regexp_replace("text", r"[\s\\\\]+", " ")
    line = F.concat(F.lit("<d"), F.col("doc_id").cast("string"), F.lit("> <text> \""), text,
                    F.lit("\" ."))
    return parse_lines(docs.where(F.col("text").isNotNull()).select(line.alias("value")), "nt")[0]


def sink_round_trip(spark, sf_dir):
    """S4 then S1: document texts with line breaks and tabs as literals, and the schema."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").isNotNull())
    texts = docs.select(F.concat(F.lit("ex:doc"), F.col("doc_id").cast("string")).alias("s"),
                        F.lit("ex:text of").alias("p"), F.col("text").alias("o"))
    g = derived_graph(spark, sf_dir)
    path = state_path(spark, "round-trip")
    write_graph(Graph(abox=texts, tbox=g.tbox), path, fmt="nt")
    return read_graph(spark, path, fmt="nt").triples()


def _escaped_lines(spark, sf_dir):
    """Lines of documents in which characters are spelled as escapes of every kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").isNotNull())
    spelled = F.replace("text", F.lit("\\"), F.lit("\\\\"))
    for plain, escape in [("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ('"', '\\"'), ("'", "\\'"), ("e", "\\u0065"),
                          ("é", "\\u00E9"), ("ü", "\\U000000fC"), ("\u0085", "\\u0085"), ("\u2028", "\\u2028"),
                          ("\u2029", "\\u2029"), ("\x0b", "\\u000B"), ("\x0c", "\\f"), ("\b", "\\b")]:
        spelled = F.replace(spelled, F.lit(plain), F.lit(escape))
    tail = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("@"), F.upper("lang")))
            .when(F.col("doc_id") % 3 == 1, F.lit("^^<http://www.w3.org/2001/XMLSchema#string>"))
            .otherwise(F.lit("^^<ex:note>")))
    smile = F.when(F.col("doc_id") % 2 == 0, F.lit("\\uD83D\\uDE00")).otherwise(F.lit("\\U0001F600"))
    return docs.select(F.concat(
        F.lit("_:d"), F.col("doc_id"), F.lit(" <ex:\\u0074ext> \""), spelled, smile, F.lit('"'),
        F.coalesce(tail, F.lit("")), F.lit(" .")).alias("value"))


def nt_terms(spark, sf_dir):
    """Terms in their parts; every spelling of a character meets its plain form."""
    triples = parse_lines(_escaped_lines(spark, sf_dir), "nt")[0]
    part = lambda c: term_parts(F.col(c))
    return triples.select(
        part("s")["kind"].alias("s_kind"), part("s")["value"].alias("s"), part("p")["kind"].alias("p_kind"),
        part("p")["value"].alias("p"), part("o").alias("t")).select("s_kind", "s", "p_kind", "p", "t.*")


def load_graph_q(spark, sf_dir):
    """S3: instances and schema from separate paths, written by S4 as text."""
    path = state_path(spark, "load-graph")
    write_graph(derived_graph(spark, sf_dir), path, fmt="nt")
    return load_graph(spark, path + "/instance", path + "/schema", fmt="nt").triples()


def property_kinds(spark, sf_dir):
    tbox = derived_graph(spark, sf_dir).tbox
    return union_all([properties_of_kind(tbox, c).select(F.lit(c).alias("kind"), "prop")
                      for c in V.PROPERTY_CLASSES])


def inverse_pairs_q(spark, sf_dir):
    return inverse_pairs(derived_graph(spark, sf_dir).tbox)


def restrictions_q(spark, sf_dir):
    tbox = derived_graph(spark, sf_dir).tbox
    return union_all([restrictions(tbox, k).select(F.lit(k).alias("kind"), "v", "prop", "filler")
                      for k in V.RESTRICTION_KINDS])


def rdfs11(spark, sf_dir):
    return closure.rdfs11(derived_graph(spark, sf_dir).tbox)


def rdfs5(spark, sf_dir):
    return closure.rdfs5(derived_graph(spark, sf_dir).tbox)


def rdfs2(spark, sf_dir):
    g = derived_graph(spark, sf_dir)
    return R.rdfs2(g.abox, relation(g.tbox, V.RDFS_DOMAIN))


def rdfs3(spark, sf_dir):
    g = derived_graph(spark, sf_dir)
    return R.rdfs3(g.abox, relation(g.tbox, V.RDFS_RANGE))


def rdfs7(spark, sf_dir):
    g = derived_graph(spark, sf_dir)
    return R.rdfs7(g.abox, _closed(g.tbox, V.RDFS_SUBPROPERTY_OF))


def rdfs9(spark, sf_dir):
    g = derived_graph(spark, sf_dir)
    return R.rdfs9(types_of(g.abox), _closed(g.tbox, V.RDFS_SUBCLASS_OF))


def new_facts_q(spark, sf_dir):
    """Conclusions of RDFS 2, 3, 7, 9 that are not asserted."""
    g = derived_graph(spark, sf_dir)
    cand = union_all([
        R.rdfs2(g.abox, relation(g.tbox, V.RDFS_DOMAIN), distinct=False),
        R.rdfs3(g.abox, relation(g.tbox, V.RDFS_RANGE), distinct=False),
        R.rdfs7(g.abox, _closed(g.tbox, V.RDFS_SUBPROPERTY_OF), distinct=False),
        R.rdfs9(types_of(g.abox), _closed(g.tbox, V.RDFS_SUBCLASS_OF), distinct=False),
    ])
    return new_facts(cand, g.abox)


def _prop_rule(rule, kind):
    def q(spark, sf_dir):
        g = derived_graph(spark, sf_dir)
        return rule(g.abox, properties_of_kind(g.tbox, kind))
    return q


owl1 = _prop_rule(O.owl1, V.OWL_FUNCTIONAL_PROPERTY)
owl2 = _prop_rule(O.owl2, V.OWL_INVERSE_FUNCTIONAL_PROPERTY)
owl3 = _prop_rule(O.owl3, V.OWL_SYMMETRIC_PROPERTY)
owl4 = _prop_rule(closure.owl4, V.OWL_TRANSITIVE_PROPERTY)


def owl4_compact(spark, sf_dir):
    """C4 by labels: which of some pairs per turn the transitive closure holds."""
    g = derived_graph(spark, sf_dir)
    found = owl4_labels(g.abox, properties_of_kind(g.tbox, V.OWL_TRANSITIVE_PROPERTY))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    term = lambda t: F.concat(F.lit("ex:conv"), F.col("conv_id"), F.lit("_"), t)
    t, zero = F.col("turn"), F.lit(0)
    pair = lambda a, b: F.struct(F.lit("ex:replyTo").alias("p"), term(a).alias("s"), term(b).alias("o"))
    pairs = turns.select(F.explode(F.array(pair(t, zero), pair(t, t - 2), pair(zero, t), pair(t, t))).alias("x"))
    return found.reachable(pairs.select("x.*"))


def owl8(spark, sf_dir):
    g = derived_graph(spark, sf_dir)
    return O.owl8(g.abox, inverse_pairs(g.tbox))


def owl14a(spark, sf_dir):
    g = derived_graph(spark, sf_dir)
    return O.owl14a(g.abox, restrictions(g.tbox, "hasValue"))


def owl14b(spark, sf_dir):
    g = derived_graph(spark, sf_dir)
    return O.owl14b(types_of(g.abox), restrictions(g.tbox, "hasValue"))


def owl15(spark, sf_dir):
    g = derived_graph(spark, sf_dir)
    return O.owl15(g.abox, types_of(g.abox), restrictions(g.tbox, "someValuesFrom"))


def owl16(spark, sf_dir):
    g = derived_graph(spark, sf_dir)
    return O.owl16(g.abox, types_of(g.abox), restrictions(g.tbox, "allValuesFrom"))


def _clusters(spark, sf_dir, stored=False):
    """Clusters of asserted sameAs plus the OWL 1/2 links of the asserted ABox.

    The links read the ABox five times; ``stored`` builds it from the tables once.
    """
    g = derived_graph(spark, sf_dir)
    if stored:
        g = Graph(abox=pin(g.abox), tbox=pin(g.tbox))
    links = O.owl1(g.abox, properties_of_kind(g.tbox, V.OWL_FUNCTIONAL_PROPERTY),
                   distinct=False).unionByName(
        O.owl2(g.abox, properties_of_kind(g.tbox, V.OWL_INVERSE_FUNCTIONAL_PROPERTY),
               distinct=False))
    pairs = S.same_as_pairs(g.abox).unionByName(S.same_as_pairs(links))
    return g, S.same_as_clusters(pairs)


def owl7_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)[1]


def cluster_members(spark, sf_dir):
    """Every cluster with its size, largest member and member list."""
    return S.cluster_members(_clusters(spark, sf_dir, stored=True)[1]).withColumn(
        "members", F.array_join("members", " "))


def cluster_pages(spark, sf_dir):
    """Member lists in pages of two, so that given clusters have several."""
    return S.cluster_pages(_clusters(spark, sf_dir, stored=True)[1], size=2).select(
        "id", "page", F.array_join("members", " ").alias("members"))


def owl11(spark, sf_dir):
    """Every substitution of equal terms, spelled out."""
    g, clusters = _clusters(spark, sf_dir, stored=True)
    return S.substituted(g.abox, clusters)


def owl11_expanded(spark, sf_dir):
    """J14 on demand: the text hashes of all documents, over every equal document."""
    g, clusters = _clusters(spark, sf_dir)
    facts = Forest(measure(clusters)).canonical(S.owl11(g.abox, clusters))
    return expanded(facts.where(F.col("p") == "ex:textHash"), clusters)


def materialize_rdfs_derived(spark, sf_dir):
    return materialize_rdfs(derived_graph(spark, sf_dir), output="derived").abox


def materialize_rdfs_all(spark, sf_dir):
    return materialize_rdfs(derived_graph(spark, sf_dir), output="all").abox


def materialize_rdfs_schema(spark, sf_dir):
    return materialize_rdfs(derived_graph(spark, sf_dir)).tbox


def materialize_owl_q(spark, sf_dir):
    return materialize_owl(derived_graph(spark, sf_dir)).abox


def materialize_owl_encoded_q(spark, sf_dir):
    """The clusters' materialisation over codes: rules, links, merged terms."""
    return materialize_owl_encoded(derived_graph(spark, sf_dir), same_as="clusters").abox


def owl7_links(spark, sf_dir):
    return S.cluster_links(_clusters(spark, sf_dir)[1])


def materialize_owl_transitive(spark, sf_dir):
    return materialize_owl(derived_graph(spark, sf_dir), transitive=True).abox


def materialize_owl_clusters(spark, sf_dir):
    return materialize_owl(derived_graph(spark, sf_dir), same_as="clusters").abox


def materialize_owl_merged_q(spark, sf_dir):
    """Rules and merging in one fixpoint."""
    return materialize_owl_merged(merge_graph(spark, sf_dir)).abox


def materialize_owl_batch(spark, sf_dir):
    """A stored materialisation of two thirds of the triples, extended by the rest."""
    g = derived_graph(spark, sf_dir)
    late = F.pmod(F.xxhash64("s", "p", "o"), F.lit(3)) == 0
    path = state_path(spark, "materialised")
    with pinned(g.abox) as abox:  # both parts from one reading of the tables
        materialize_owl_at(Graph(abox=abox.where(~late), tbox=g.tbox), path)
        extend(path, abox.where(late))
    return read_materialized(spark, path).abox


def materialize_owl_schema(spark, sf_dir):
    return OwlSchema.of(derived_graph(spark, sf_dir).tbox).as_tbox()


QUERIES: dict[str, Query] = {
    "normalise_vocab": normalise_vocab,
    "split_tbox": split_tbox,
    "split_abox": split_abox,
    "split_abox_parts": split_abox_parts,
    "parse_tokens": parse_tokens,
    "parse_nt": parse_nt,
    "rejects": rejects,
    "sink_round_trip": sink_round_trip,
    "nt_terms": nt_terms,
    "load_graph": load_graph_q,
    "property_kinds": property_kinds,
    "inverse_pairs": inverse_pairs_q,
    "restrictions": restrictions_q,
    "rdfs2": rdfs2,
    "rdfs3": rdfs3,
    "rdfs5": rdfs5,
    "rdfs7": rdfs7,
    "rdfs9": rdfs9,
    "rdfs11": rdfs11,
    "new_facts": new_facts_q,
    "owl1": owl1,
    "owl2": owl2,
    "owl3": owl3,
    "owl4": owl4,
    "owl4_compact": owl4_compact,
    "owl7_clusters": owl7_clusters,
    "cluster_members": cluster_members,
    "cluster_pages": cluster_pages,
    "owl7_links": owl7_links,
    "owl8": owl8,
    "owl11": owl11,
    "owl11_expanded": owl11_expanded,
    "owl14a": owl14a,
    "owl14b": owl14b,
    "owl15": owl15,
    "owl16": owl16,
    "materialize_rdfs_derived": materialize_rdfs_derived,
    "materialize_rdfs_all": materialize_rdfs_all,
    "materialize_rdfs_schema": materialize_rdfs_schema,
    "materialize_owl": materialize_owl_q,
    "materialize_owl_transitive": materialize_owl_transitive,
    "materialize_owl_clusters": materialize_owl_clusters,
    "materialize_owl_encoded": materialize_owl_encoded_q,
    "materialize_owl_schema": materialize_owl_schema,
    "materialize_owl_merged": materialize_owl_merged_q,
    "materialize_owl_batch": materialize_owl_batch,
}
