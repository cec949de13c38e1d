"""A kept materialisation: batches, a lost driver, a grown schema."""

import pytest

from conftest import rows
from entailer.functions import vocab as V
from entailer.operators.durable import DurableFacts
from entailer.operators.graph import Graph
from entailer.plans import stored
from entailer.plans.materialize import materialize_owl

TRIPLES = "s string, p string, o string"
TBOX = [("next", V.RDF_TYPE, V.OWL_TRANSITIVE_PROPERTY), ("next", V.RDFS_DOMAIN, "Node"),
        ("Node", V.RDFS_SUBCLASS_OF, "Thing"), ("R", V.OWL_SOME_VALUES_FROM, "Good"),
        ("R", V.OWL_ON_PROPERTY, "next"), ("key", V.RDF_TYPE, V.OWL_INVERSE_FUNCTIONAL_PROPERTY)]
BASE = [(f"n{i}", "next", f"n{i + 1}") for i in range(6)] + [("a", "key", "k"), (None, "next", "x")]
BATCH = [("n6", V.RDF_TYPE, "Good"), ("n6", "next", "n7"), ("b", "key", "k"), ("n0", "next", "n1"), ("n0", "next", None)]


def frame(spark, triples):
    return spark.createDataFrame(triples, TRIPLES)


_done = {}


def full(spark, triples, tbox=TBOX):
    """One run over everything, kept for the next test that asks for the same."""
    asked = str((triples, tbox))
    if asked not in _done:
        _done[asked] = _full(spark, triples, tbox)
    return _done[asked]


def _full(spark, triples, tbox):
    return rows(materialize_owl(Graph(abox=frame(spark, triples), tbox=frame(spark, tbox)), transitive=True).abox)


def test_base_and_batch_equal_a_full_run(spark, tmp_path):
    path = str(tmp_path / "kb")
    stored.materialize_owl_at(Graph(abox=frame(spark, BASE), tbox=frame(spark, TBOX)), path, transitive=True)
    assert rows(stored.read_materialized(spark, path).abox) == full(spark, BASE)
    before = DurableFacts.open(spark, path)
    stored.extend(path, frame(spark, BATCH))
    assert rows(stored.read_materialized(spark, path).abox) == full(spark, BASE + BATCH)
    after = DurableFacts.open(spark, path)
    # The batch is one round; known facts are not stored or derived again.
    assert after.where(f"rnd = {before.rounds}").count() == 3
    assert after.all().count() == after.all().distinct().count()
    stored.extend(path, frame(spark, []))
    assert rows(stored.read_materialized(spark, path).abox) == full(spark, BASE + BATCH)
    with pytest.raises(ValueError, match="already"):
        stored.materialize_owl_at(Graph(abox=frame(spark, BASE), tbox=frame(spark, TBOX)), path)


def test_lost_driver(spark, tmp_path, monkeypatch):
    """The driver ends in the middle of a round's write; another one goes on."""
    path = str(tmp_path / "kb")
    write, calls = DurableFacts._write, []

    def dies(self, df):
        write(self, df)
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt  # the round is written, but not committed

    monkeypatch.setattr(DurableFacts, "_write", dies)
    with pytest.raises(KeyboardInterrupt):
        stored.materialize_owl_at(Graph(abox=frame(spark, BASE + BATCH), tbox=frame(spark, TBOX)), path, transitive=True)
    monkeypatch.undo()
    with pytest.raises(ValueError, match="not finished"):
        stored.read_materialized(spark, path)
    (tmp_path / "kb" / "manifest" / "seq=99").mkdir()  # a manifest row that was being written
    assert DurableFacts.open(spark, path).rounds == 2
    stored.resume(spark, path)
    assert rows(stored.read_materialized(spark, path).abox) == full(spark, BASE + BATCH)
    stored.resume(spark, path)  # nothing left to do


def test_schema_may_grow_but_not_shrink(spark, tmp_path):
    path = str(tmp_path / "kb")
    stored.materialize_owl_at(Graph(abox=frame(spark, BASE), tbox=frame(spark, TBOX)), path, transitive=True)
    more = TBOX + [("Thing", V.RDFS_SUBCLASS_OF, "Top"), ("next", V.OWL_INVERSE_OF, "last")]
    stored.extend(path, frame(spark, BATCH), frame(spark, more))
    got = stored.read_materialized(spark, path)
    assert rows(got.abox) == full(spark, BASE + BATCH, more)
    assert ("last", V.OWL_INVERSE_OF, "next") in rows(got.tbox)
    with pytest.raises(ValueError, match="lost"):
        stored.extend(path, frame(spark, []), frame(spark, TBOX))


def test_store_that_is_dealt_out_anew(spark, tmp_path, monkeypatch):
    """More buckets on the way: the committed folder follows, the old one goes."""
    from entailer.operators import fixpoint
    path = str(tmp_path / "kb")
    monkeypatch.setattr(fixpoint, "bucket_count", lambda _, size: 1 if size < 2000 else 8)
    stored.materialize_owl_at(Graph(abox=frame(spark, BASE), tbox=frame(spark, TBOX)), path, transitive=True)
    store = DurableFacts.open(spark, path)
    assert store.buckets == 8
    assert len([f for f in (tmp_path / "kb").iterdir() if f.name.startswith("facts-")]) == 1
    assert rows(stored.read_materialized(spark, path).abox) == full(spark, BASE)
