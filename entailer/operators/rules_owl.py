"""OWL-Horst (pD*) rules 1, 2, 3, 8, 14a, 14b, 15, 16.

All rules are equi-joins. Schema sides (property sets, inverse pairs,
restrictions) are broadcast after a size check and salted beyond it (see
:func:`joins.join_small`); the joins between two
instance-sized inputs (OWL 15/16 and the grouping in OWL 1/2) are joins of
plain shuffles, whose hot keys AQE's skew-join handling splits.

OWL 1 and 2 derive ``owl:sameAs`` between all values sharing a key. The
output is the *star* form: every value is linked to the smallest value of its
group (``v sameAs min``), which has the same sameAs closure (OWL 6/7) as the
all-pairs form but is linear in the input -- a group holding a third of the
data would otherwise emit a quadratic number of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailer.functions import vocab as V
from entailer.operators.joins import join_back, join_small
from entailer.operators.rules_rdfs import SchemaSide, _out, renamed


def prune(facts: DataFrame, props: SchemaSide) -> DataFrame:
    """Keep facts whose predicate is in the property set ``props(prop)``."""
    return join_small(facts, renamed(props, ("prop", "p")), ["p"], "left_semi")


def _star(facts: DataFrame, key: list[str], value: str) -> DataFrame:
    """Link every ``value`` of a ``key`` group to the group minimum.

    The minimum is combined on the map side and joined back on the key in a
    way that lets AQE split a hot group over tasks.
    """
    rep = facts.groupBy(*key).agg(F.min(value).alias("rep"))
    return (join_back(facts, rep, key).where(F.col(value) != F.col("rep"))
            .select(F.col(value).alias("s"), F.lit(V.OWL_SAME_AS).alias("p"),
                    F.col("rep").alias("o")))


def owl1(facts: DataFrame, functional: SchemaSide, distinct: bool = True) -> DataFrame:
    """``p`` functional, ``u p v, u p w => v sameAs w`` (star form)."""
    return _out(_star(prune(facts, functional), ["s", "p"], "o"), distinct)


def owl2(facts: DataFrame, inv_functional: SchemaSide, distinct: bool = True) -> DataFrame:
    """``p`` inverse-functional, ``v p u, w p u => v sameAs w`` (star form)."""
    return _out(_star(prune(facts, inv_functional), ["p", "o"], "s"), distinct)


def owl3(facts: DataFrame, symmetric: SchemaSide, distinct: bool = True) -> DataFrame:
    """``p`` symmetric, ``s p o => o p s``."""
    out = prune(facts, symmetric).select(
        F.col("o").alias("s"), "p", F.col("s").alias("o"))
    return _out(out, distinct)


def owl8(facts: DataFrame, inverses: SchemaSide, distinct: bool = True) -> DataFrame:
    """``p inverseOf q``, ``s p o => o q s`` (8a and 8b via the symmetric view).

    ``inverses`` is ``(prop, inv)`` from :func:`graph.inverse_pairs`; every
    inverse of a property is used, not just one.
    """
    inv = renamed(inverses, ("prop", "p"), ("inv", "inv"))
    out = join_small(facts, inv, ["p"]).select(
        F.col("o").alias("s"), F.col("inv").alias("p"), F.col("s").alias("o"))
    return _out(out, distinct)


def owl14a(facts: DataFrame, has_value: SchemaSide, distinct: bool = True) -> DataFrame:
    """``v hasValue w, v onProperty p, u p w => u rdf:type v``."""
    hv = renamed(has_value, ("prop", "p"), ("filler", "o"), ("v", "v"))
    out = join_small(facts, hv, ["p", "o"]).select(
        "s", F.lit(V.RDF_TYPE).alias("p"), F.col("v").alias("o"))
    return _out(out, distinct)


def owl14b(types: DataFrame, has_value: SchemaSide, distinct: bool = True) -> DataFrame:
    """``v hasValue w, v onProperty p, u rdf:type v => u p w``."""
    hv = renamed(has_value, ("v", "cls"), ("prop", "prop"), ("filler", "filler"))
    out = join_small(types, hv, ["cls"]).select(
        "s", F.col("prop").alias("p"), F.col("filler").alias("o"))
    return _out(out, distinct)


def owl15(facts: DataFrame, types: DataFrame, some: SchemaSide,
          distinct: bool = True) -> DataFrame:
    """``v someValuesFrom w, v onProperty p, x rdf:type w, u p x => u rdf:type v``.

    First the (broadcast) restrictions select the typed individuals ``x`` that
    can fill one, then those meet the triples on ``(x, p)``.
    """
    fillers = join_small(types, renamed(some, ("filler", "cls"), ("prop", "prop"), ("v", "v")),
                         ["cls"]).select(F.col("s").alias("x"), "prop", "v")
    edges = prune(facts, some).select(
        F.col("o").alias("x"), F.col("p").alias("prop"), F.col("s").alias("u"))
    out = edges.join(fillers, ["x", "prop"]).select(
        F.col("u").alias("s"), F.lit(V.RDF_TYPE).alias("p"), F.col("v").alias("o"))
    return _out(out, distinct)


def owl16(facts: DataFrame, types: DataFrame, all_: SchemaSide,
          distinct: bool = True) -> DataFrame:
    """``v allValuesFrom w, v onProperty p, u rdf:type v, u p x => x rdf:type w``."""
    members = join_small(types, renamed(all_, ("v", "cls"), ("prop", "prop"), ("filler", "w")),
                         ["cls"]).select(F.col("s").alias("u"), "prop", "w")
    edges = prune(facts, all_).select(
        F.col("s").alias("u"), F.col("p").alias("prop"), F.col("o").alias("x"))
    out = edges.join(members, ["u", "prop"]).select(
        F.col("x").alias("s"), F.lit(V.RDF_TYPE).alias("p"), F.col("w").alias("o"))
    return _out(out, distinct)
