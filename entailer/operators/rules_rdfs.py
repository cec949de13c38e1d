"""RDFS entailment rules 2, 3, 7 and 9 (J1-J4) as DataFrame joins.

Every rule joins instance facts with a schema relation on a low-cardinality
key (a predicate or a class) through :func:`joins.join_small`: broadcast after
a size check, salted beyond it, so the instance side is never shuffled on a
hot key.

Each rule returns candidate triples ``(s, p, o)``; ``distinct=True`` (the
default for direct use) removes duplicates, the fixpoint driver instead
deduplicates the union of all rules once per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailer.functions import vocab as V
from entailer.operators.joins import Sized, join_small, measure

SchemaSide = DataFrame | Sized


def sized(rel: SchemaSide) -> Sized:
    return rel if isinstance(rel, Sized) else measure(rel)


def renamed(rel: SchemaSide, *cols) -> Sized:
    """``rel`` measured once and re-projected with ``(old, new)`` renames."""
    return sized(rel).map(lambda d: d.select(*[F.col(a).alias(b) for a, b in cols]))


def _out(df: DataFrame, distinct: bool) -> DataFrame:
    return df.distinct() if distinct else df


def rdfs2(facts: DataFrame, domain: SchemaSide, distinct: bool = True) -> DataFrame:
    """``p rdfs:domain x, s p o => s rdf:type x``. ``domain`` is ``(s=p, o=x)``."""
    d = renamed(domain, ("s", "p"), ("o", "cls"))
    out = join_small(facts.select("s", "p"), d, ["p"]).select(
        "s", F.lit(V.RDF_TYPE).alias("p"), F.col("cls").alias("o"))
    return _out(out, distinct)


def rdfs3(facts: DataFrame, range_: SchemaSide, distinct: bool = True) -> DataFrame:
    """``p rdfs:range x, s p o => o rdf:type x``."""
    r = renamed(range_, ("s", "p"), ("o", "cls"))
    out = join_small(facts.select("p", "o"), r, ["p"]).select(
        F.col("o").alias("s"), F.lit(V.RDF_TYPE).alias("p"), F.col("cls").alias("o"))
    return _out(out, distinct)


def rdfs7(facts: DataFrame, subprop: SchemaSide, distinct: bool = True) -> DataFrame:
    """``s p o, p rdfs:subPropertyOf q => s q o`` (``subprop`` closed or not)."""
    sp = renamed(subprop, ("s", "p"), ("o", "q"))
    out = join_small(facts, sp, ["p"]).select("s", F.col("q").alias("p"), "o")
    return _out(out, distinct)


def rdfs9(types: DataFrame, subclass: SchemaSide, distinct: bool = True) -> DataFrame:
    """``u rdf:type v, v rdfs:subClassOf w => u rdf:type w``.

    ``types`` is ``(s, cls)``; ``subclass`` is ``(s=v, o=w)``.
    """
    sc = renamed(subclass, ("s", "cls"), ("o", "sup"))
    out = join_small(types, sc, ["cls"]).select(
        "s", F.lit(V.RDF_TYPE).alias("p"), F.col("sup").alias("o"))
    return _out(out, distinct)
