"""Transitive closures (C1-C4) as semi-naive loops of DataFrame joins.

Spark SQL's recursive CTEs accept only ``UNION ALL`` and stop on cycles, so
closures are driver loops: each round joins the newest paths (the delta) with
the edges, keeps only paths not known yet, appends them to a bucketed fact
table in the checkpoint folder and stops when nothing new appears.

``keys`` lets one loop close many relations at once (OWL 4 closes every
transitive property together, keyed by the predicate).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailer.functions import vocab as V
from entailer.operators.fixpoint import FactStore, fresh, pin
from entailer.operators.graph import as_triples, relation
from entailer.operators.joins import Sized, join_small, measure


def compose(left: "DataFrame | Sized", right: "DataFrame | Sized", keys: list[str]) -> DataFrame:
    """Paths ``a -> m`` (left) followed by ``m -> b`` (right) give ``a -> b``.

    A side that was measured under the broadcast bound is broadcast (the
    smaller one of two), so the other side is not shuffled; beyond the bound
    both sides are plain shuffles, whose hot keys AQE splits.
    """
    cols = keys + ["s", "o"]
    small = {side: x.rows for side, x in (("l", left), ("r", right))
             if isinstance(x, Sized) and x.broadcast}
    pick = min(small, key=small.get) if small else None
    frame = lambda x: x.df if isinstance(x, Sized) else x
    l_ = fresh(frame(left).select(*cols), *(keys + ["a", "m"]))
    r_ = fresh(frame(right).select(*cols), *(keys + ["m", "b"]))
    l_, r_ = (F.broadcast(l_) if pick == "l" else l_), (F.broadcast(r_) if pick == "r" else r_)
    return l_.join(r_, keys + ["m"]).select(
        *keys, F.col("a").alias("s"), F.col("b").alias("o"))


def transitive_closure(edges: DataFrame, keys: Sequence[str] = (),
                       method: str = "linear") -> DataFrame:
    """Least transitive relation containing ``edges(*keys, s, o)``.

    ``linear``: new paths = delta . edges (one edge longer per round; best for
    shallow hierarchies). ``doubling``: new paths = delta . known and
    previous . delta (path lengths double per round, so ``log2(longest path)``
    rounds). The loop ends when a round finds no new path; paths are pairs of
    the finitely many terms, so it always ends. Reflexive pairs appear only
    through cycles. Input duplicates are irrelevant: the state is a set, kept
    in a :class:`FactStore` whatever its size. The anti-join reads known paths
    in place; composing shuffles them unless the delta is small enough to be
    broadcast.
    """
    if method not in ("linear", "doubling"):
        raise ValueError(f"unknown closure method {method!r}")
    keys = list(keys)
    cols = keys + ["s", "o"]
    size = measure(pin(edges.select(*cols).dropna().distinct()))
    store = FactStore(size.df.sparkSession, cols, size.bytes)
    base = size.map(lambda d: store.add(d, size.bytes))
    delta = base
    while delta.rows:
        k = store.rounds - 1
        known = store.upto(k)
        if method == "linear":
            cand = compose(delta, base, keys)
        else:
            cand = compose(delta, known, keys)
            if k > 0:
                cand = cand.unionByName(compose(store.upto(k - 1), delta, keys))
        delta = measure(store.add(store.new(cand, known), placed=True))
        store.grown(delta.bytes)
        delta = delta.map(lambda _: store.where(F.col("rnd") == k + 1))
    return store.all()


def rdfs11(tbox: DataFrame) -> DataFrame:
    """Closure of ``rdfs:subClassOf`` as triples."""
    return as_triples(transitive_closure(relation(tbox, V.RDFS_SUBCLASS_OF)), V.RDFS_SUBCLASS_OF)


def rdfs5(tbox: DataFrame) -> DataFrame:
    """Closure of ``rdfs:subPropertyOf`` as triples."""
    return as_triples(transitive_closure(relation(tbox, V.RDFS_SUBPROPERTY_OF)),
                      V.RDFS_SUBPROPERTY_OF)


def owl4(facts: DataFrame, transitive_props: DataFrame) -> DataFrame:
    """C4: ``p`` transitive, ``u p w, w p v => u p v`` for all such ``p`` at once.

    Output includes the asserted edges of the transitive properties.
    ``transitive_props`` has one column ``prop``.
    """
    props = transitive_props.select(F.col("prop").alias("p"))
    edges = join_small(facts, props, ["p"], "left_semi")
    closed = transitive_closure(edges, keys=["p"], method="doubling")
    return closed.select("s", "p", "o")
