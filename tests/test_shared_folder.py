"""State on a real cluster: a ``file:`` folder counts as shared if the executors' rows are found in it."""

import pytest

from conftest import rows
from entailer.functions import vocab as V
from entailer.operators import closure, fixpoint


@pytest.fixture()
def cluster(spark, monkeypatch):
    """The session as if its master were a cluster's, with nothing known of its folder."""
    assert spark.sparkContext.getCheckpointDir().startswith("file:")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(fixpoint, "_shared", {}, raising=False)
    with fixpoint.state_scope(spark):
        yield spark


def test_a_mounted_folder_holds_state_on_a_cluster(cluster):
    tbox = cluster.createDataFrame([("A", V.RDFS_SUBCLASS_OF, "B"), ("B", V.RDFS_SUBCLASS_OF, "C")],
                                   "s string, p string, o string")
    assert rows(closure.rdfs11(tbox), "s", "o") == {("A", "B"), ("B", "C"), ("A", "C")}


def test_the_trial_is_made_once(cluster, monkeypatch):
    made = []
    monkeypatch.setattr(fixpoint, "_is_shared", lambda spark, folder: made.append(folder) or True)
    assert fixpoint.ensure_checkpoint_dir(cluster) == fixpoint.ensure_checkpoint_dir(cluster)
    assert len(made) == 1


def test_a_folder_that_loses_rows_is_refused(cluster, monkeypatch):
    """Part files of other machines are missing where the driver lists the folder."""
    class Partly:
        sparkContext, read = cluster.sparkContext, cluster.read

        @staticmethod
        def range(start, end, step, partitions):
            return cluster.range(start, end - 1, step, partitions)

    with pytest.raises(RuntimeError, match="local to each machine"):
        fixpoint.ensure_checkpoint_dir(Partly)


def _folders(monkeypatch, sc, folder, warehouse):
    """The context as if ``folder`` and ``warehouse`` were set; the folder in use."""
    used = [folder]
    conf = {"spark.sql.warehouse.dir": f"file:{warehouse}"}
    monkeypatch.setattr(sc, "getCheckpointDir", lambda: used[0])
    monkeypatch.setattr(sc, "setCheckpointDir", lambda d: used.__setitem__(0, d))
    monkeypatch.setattr(sc, "getConf", lambda: conf)
    return used


@pytest.mark.parametrize("folder", [None, "file:/proc/entailer-none"])
def test_the_warehouse_holds_state_if_the_folder_cannot(cluster, monkeypatch, tmp_dir, folder):
    """No folder at all, or one where tasks cannot write."""
    used = _folders(monkeypatch, cluster.sparkContext, folder, tmp_dir)
    tbox = cluster.createDataFrame([("A", V.RDFS_SUBPROPERTY_OF, "B"), ("B", V.RDFS_SUBPROPERTY_OF, "C")],
                                   "s string, p string, o string")
    assert rows(closure.rdfs5(tbox), "s", "o") == {("A", "B"), ("B", "C"), ("A", "C")}
    assert used[0].startswith(f"file:{tmp_dir}/")


def test_neither_folder_nor_warehouse_shared(cluster, monkeypatch, tmp_dir):
    _folders(monkeypatch, cluster.sparkContext, None, tmp_dir)
    monkeypatch.setattr(fixpoint, "_is_shared", lambda spark, folder: False)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir is not set"):
        fixpoint.ensure_checkpoint_dir(cluster)
