"""The graph model and its projections.

A triple frame ``T`` has columns ``s, p, o`` (strings). A binary relation
``R`` has columns ``s, o``. Every projection here is a filter + select over
the same scan, so Catalyst pushes the predicate test into the parquet reader.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entailer.functions import vocab as V

TRIPLE_COLS = ("s", "p", "o")


@dataclass(frozen=True)
class Graph:
    """Instance data (ABox) and schema data (TBox), both ``(s, p, o)``.

    ``rejects`` holds the input lines that were no triples (``value``), where
    the graph was read from text.
    """

    abox: DataFrame
    tbox: DataFrame
    rejects: DataFrame | None = None

    def triples(self) -> DataFrame:
        return self.abox.unionByName(self.tbox)


def is_schema(p: Column | None = None, o: Column | None = None) -> Column:
    """The 13 schema categories as one predicate."""
    p = F.col("p") if p is None else p
    o = F.col("o") if o is None else o
    return p.isin(*V.SCHEMA_PREDICATES) | ((p == V.RDF_TYPE) & o.isin(*V.PROPERTY_CLASSES))


def split_graph(triples: DataFrame) -> Graph:
    """One input -> (ABox, TBox) by two complementary filters (no anti-join)."""
    schema = is_schema()
    return Graph(abox=triples.where(~schema), tbox=triples.where(schema))


def relation(triples: DataFrame, pred: str) -> DataFrame:
    """P2a-P2i: ``(s, o)`` of the triples with predicate ``pred``."""
    return triples.where(F.col("p") == pred).select("s", "o")


def properties_of_kind(tbox: DataFrame, cls: str) -> DataFrame:
    """P2j-P2m: properties declared ``rdf:type cls`` -> one column ``prop``."""
    return (tbox.where((F.col("p") == V.RDF_TYPE) & (F.col("o") == cls))
            .select(F.col("s").alias("prop")).distinct())


def split_abox(abox: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(other triples, types ``(s, cls)``, sameAs pairs ``(a, b)``)."""
    p = F.col("p")
    triples = abox.where(~p.isin(V.RDF_TYPE, V.OWL_SAME_AS))
    types = abox.where(p == V.RDF_TYPE).select("s", F.col("o").alias("cls"))
    sames = abox.where(p == V.OWL_SAME_AS).select(F.col("s").alias("a"), F.col("o").alias("b"))
    return triples, types, sames


def types_of(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("p") == V.RDF_TYPE).select("s", F.col("o").alias("cls"))


def inverse_pairs(tbox: DataFrame) -> DataFrame:
    """P5: ``p inverseOf q`` in both directions -> ``(prop, inv)``, distinct."""
    inv = relation(tbox, V.OWL_INVERSE_OF)
    both = inv.select(F.col("s").alias("prop"), F.col("o").alias("inv")).unionByName(
        inv.select(F.col("o").alias("prop"), F.col("s").alias("inv")))
    return both.distinct()


def restrictions(tbox: DataFrame, kind: str) -> DataFrame:
    """Restriction nodes of one kind joined with their onProperty.

    ``kind`` is ``hasValue``, ``someValuesFrom`` or ``allValuesFrom``. Output
    ``(v, prop, filler)``; multi-valued on both sides (a node may have several
    onProperty / filler triples), hence a join rather than a lookup map.
    """
    filler = relation(tbox, V.RESTRICTION_KINDS[kind]).select(
        F.col("s").alias("v"), F.col("o").alias("filler"))
    onprop = relation(tbox, V.OWL_ON_PROPERTY).select(
        F.col("s").alias("v"), F.col("o").alias("prop"))
    return filler.join(onprop, "v").select("v", "prop", "filler").distinct()


def as_triples(rel: DataFrame, pred: str | Column, s: str = "s", o: str = "o") -> DataFrame:
    """``(s, o)`` -> ``(s, pred, o)``."""
    p = pred if isinstance(pred, Column) else F.lit(pred)
    return rel.select(F.col(s).alias("s"), p.alias("p"), F.col(o).alias("o"))
