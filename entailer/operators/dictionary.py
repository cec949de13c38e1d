"""A term dictionary: reasoning over short codes instead of whole terms.

Every term of a graph gets a code, its rank among all terms in base 36 with leading
zeros. Ranks are dense, so no two terms can share a code, and codes sort as their terms
do, so the smallest term of a cluster has the smallest code too. What the rules shuffle,
store and compare are the codes; terms are joined back at the end.

The standard vocabulary stays as it is, for rules name it; its terms are bracketed and
codes are not, so they cannot meet. Order between a code and a vocabulary term is not
that of the terms: where a graph says that a vocabulary term equals another term, another
member may name their cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailer.functions import vocab as V
from entailer.operators.fixpoint import pin, union_all
from entailer.operators.graph import Graph
from entailer.operators.joins import Sized, measure_many
from entailer.operators.merging import mapped
from entailer.operators.ranks import ranked

BASE = 36


def code_width(terms: int) -> int:
    """Digits that number so many terms."""
    width = 1
    while BASE ** width < terms:
        width += 1
    return width


@dataclass(frozen=True)
class TermDictionary:
    """``terms(term, id)`` of a graph, and those rows of it that may be predicates."""

    terms: Sized
    predicates: Sized

    @classmethod
    def of(cls, graph: Graph) -> "TermDictionary":
        """The dictionary of all terms of ``graph``; nulls have no code.

        Few terms are predicates, but one of them may stand in a third of all triples.
        So predicates are looked up in a table of their own: those of instances, and all
        terms of the schema, from which rules take new ones.
        """
        def column(df: DataFrame, c: str) -> DataFrame:
            return df.select(F.col(c).alias("term")).where(
                F.col("term").isNotNull() & ~F.col("term").isin(*V.VOCABULARY))

        named = union_all([column(graph.abox, "p"), *(column(graph.tbox, c) for c in "spo")]).distinct()
        terms = union_all([named, column(graph.abox, "s"), column(graph.abox, "o")]).distinct()
        numbered = ranked(terms, ["term"])
        width = code_width((numbered.agg(F.max("rank")).first()[0] or 0) + 1)
        table = pin(numbered.select("term", F.lpad(
            F.conv(F.col("rank").cast("string"), 10, BASE), width, "0").alias("id")))
        return cls(*measure_many([table, pin(table.join(named, "term", "left_semi"))]))

    def _through(self, df: DataFrame, source: str, target: str) -> DataFrame:
        def side(sized: Sized) -> Sized:
            return sized.map(lambda d: d.select(source, target))

        return mapped(mapped(df, side(self.predicates), "p"), side(self.terms), "s", "o").select("s", "p", "o")

    def encode(self, graph: Graph) -> Graph:
        return Graph(abox=self._through(graph.abox, "term", "id"), tbox=self._through(graph.tbox, "term", "id"))

    def decode(self, graph: Graph) -> Graph:
        return Graph(abox=self._through(graph.abox, "id", "term"), tbox=self._through(graph.tbox, "id", "term"))
