"""A materialisation that is kept, resumed and extended (M4 over M7).

``materialize_owl_at`` runs the OWL fixpoint into a path and commits every round there.
A driver that was lost starts again from the last committed round (``resume``), and
``extend`` takes a new batch of triples: only the batch is new in the first round, so
work follows what the batch adds, not what is stored. The result is that of one run
over everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entailer.functions import vocab as V
from entailer.operators import rules_owl as O
from entailer.operators.durable import DurableFacts, schema_digest
from entailer.operators.fixpoint import new_facts, pin, pinned
from entailer.operators.graph import Graph, is_schema
from entailer.operators.joins import measure, measure_many
from entailer.plans.materialize import OwlSchema, Sides, owl_round_candidates, owl_rounds

TRIPLE = "s string, p string, o string"


def _schema_path(root: str, digest: str) -> str:
    return f"{root.rstrip('/')}/schema/{digest}"


def _recognised(tbox: DataFrame) -> DataFrame:
    return pin(tbox.select("s", "p", "o").dropna().where(is_schema()).distinct())


def _run(store: DurableFacts, schema: OwlSchema) -> None:
    """Rounds from the last stored one to the fixpoint; one over all facts if the schema grew."""
    sides = Sides.empty(store.spark, store.step.transitive)
    last = store.rounds - 1
    if store.step.whole:
        _seed(sides, schema, store.all())
        conclusions = owl_round_candidates(schema, store.all(), sides)
        delta = store.add(store.new(conclusions, store.all()), placed=True, whole=False)
    else:
        if last > 0:
            _seed(sides, schema, store.upto(last - 1))
        delta = store.where(F.col("rnd") == last)
    owl_rounds(schema, store, delta, sides)
    store.commit(finished=True)


def _seed(sides: Sides, schema: OwlSchema, facts: DataFrame) -> None:
    """What earlier rounds gave to the two-premise rules, from the stored facts."""
    sides.step(dict(zip(sides.names(), measure_many(sides.of(schema, facts)))))


def materialize_owl_at(graph: Graph, path: str, transitive: bool = False) -> None:
    """M4 into ``path``, which must not hold a materialisation yet."""
    spark = graph.abox.sparkSession
    if DurableFacts.exists(spark, path):
        raise ValueError(f"{path} holds a materialisation already: resume or extend it")
    tbox = _recognised(graph.tbox)
    digest = schema_digest(tbox)
    tbox.write.mode("overwrite").parquet(_schema_path(path, digest))
    with pinned(graph.abox.select("s", "p", "o").dropna().distinct()) as rows:
        size = measure(rows)
        store = DurableFacts(spark, path, size.bytes, digest, transitive)
        store.add(rows, size.bytes)
    _run(store, OwlSchema.of(tbox))


def _stored_schema(store: DurableFacts) -> DataFrame:
    return store.spark.read.schema(TRIPLE).parquet(_schema_path(store.root, store.step.digest))


def resume(spark: SparkSession, path: str) -> None:
    """Finish what a lost driver left at ``path``; nothing to do if it is finished."""
    store = DurableFacts.open(spark, path)
    if not store.step.finished:
        _run(store, OwlSchema.of(_stored_schema(store)))


def extend(path: str, batch: DataFrame, tbox: DataFrame | None = None) -> None:
    """Add the instance triples ``batch`` to the materialisation at ``path``.

    A new schema may only add to the stored one (a triple less could make stored
    facts wrong: :class:`ValueError`); its rules then meet all stored facts once.
    """
    spark = batch.sparkSession
    resume(spark, path)
    store = DurableFacts.open(spark, path)
    schema, changes = _stored_schema(store), {}
    if tbox is not None:
        new = _recognised(tbox)
        digest = schema_digest(new)
        if digest != store.step.digest:
            if not new_facts(schema, new).isEmpty():
                raise ValueError("the schema lost triples: materialise anew")
            new.write.mode("overwrite").parquet(_schema_path(path, digest))
            schema = new
            changes = {"digest": digest, "whole": True}
    with pinned(store.new(batch.select("s", "p", "o").dropna(), store.all())) as rows:
        store.add(rows, measure(rows).bytes, **changes)
    _run(store, OwlSchema.of(schema))


def read_materialized(spark: SparkSession, path: str) -> Graph:
    """Asserted and derived facts with OWL 1/2 star links, and the schema (M5, M6)."""
    store = DurableFacts.open(spark, path)
    if not store.step.finished:
        raise ValueError(f"the materialisation at {path} is not finished: resume it")
    schema = OwlSchema.of(_stored_schema(store))
    facts = store.all()
    links = O.owl1(facts, schema.functional, distinct=False).unionByName(
        O.owl2(facts, schema.inv_functional, distinct=False))
    sames = facts.where(F.col("p") == V.OWL_SAME_AS)
    return Graph(abox=facts.unionByName(new_facts(links, sames)), tbox=schema.as_tbox())
