"""A fact store that outlives the driver: rounds and a manifest at a path of its own (M7).

Layout under the path: ``facts-<id>/rnd=k`` (bucketed like every :class:`FactStore`),
``schema`` (the recognised schema triples) and ``manifest/seq=i``, one small JSON row
for each committed step. A step counts only once its manifest row exists; what a lost
driver left beyond it is removed when the store is opened.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entailer.operators.fixpoint import FactStore, _remember

MANIFEST = "folder string, buckets int, rounds int, bytes long, digest string, transitive boolean, finished boolean, whole boolean"


@dataclass(frozen=True)
class Step:
    """What is committed: the folder of the facts, its rounds, and for which schema.

    ``whole``: the schema grew, so the next round must read all facts.
    """

    folder: str
    buckets: int
    rounds: int
    bytes: int
    digest: str
    transitive: bool
    finished: bool
    whole: bool = False


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def schema_digest(tbox: DataFrame) -> str:
    """Independent of the order of the triples."""
    row = tbox.select(F.sha2(F.to_json(F.struct("s", "p", "o")), 256).alias("h")).distinct().agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).alias("a"),
        F.sum(F.conv(F.substring("h", 13, 12), 16, 10).cast("decimal(38,0)")).alias("b")).first()
    return f"{row['n']}-{row['a']}-{row['b']}"


class DurableFacts(FactStore):
    """A :class:`FactStore` at ``root``; every round is committed by a manifest row."""

    def __init__(self, spark: SparkSession, root: str, size_bytes: int = 0, digest: str = "",
                 transitive: bool = False):
        self.root, self.seq, self.stale = root.rstrip("/"), 0, []
        self.step = Step("", 0, 0, 0, digest, transitive, False)
        super().__init__(spark, size_bytes=size_bytes)

    def _folder(self) -> str:
        return f"{self.root}/facts-{uuid.uuid4().hex}"

    def commit(self, **changes) -> None:
        self.step = replace(self.step, folder=self.path.rsplit("/", 1)[1], buckets=self.buckets,
                            rounds=self.rounds, bytes=self.bytes, **changes)
        row = self.spark.createDataFrame([tuple(asdict(self.step).values())], MANIFEST)
        row.coalesce(1).write.json(f"{self.root}/manifest/seq={self.seq}")
        self.seq += 1
        while self.step.finished and self.stale:
            _remove(self.spark, self.stale.pop())

    def add(self, df: DataFrame, size_bytes: int = 0, placed: bool = False, **changes) -> DataFrame:
        super().add(df, size_bytes, placed)
        self.commit(finished=False, **changes)
        return self.where(F.col("rnd") == self.rounds - 1)

    def grown(self, size_bytes: int) -> None:
        before = self.path
        super().grown(size_bytes)
        if self.path != before and self.rounds:
            self.stale.append(before)  # frames of this round still read it

    @staticmethod
    def exists(spark: SparkSession, root: str) -> bool:
        return any(n.startswith("seq=") for n in _names(spark, root.rstrip("/") + "/manifest"))

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "DurableFacts":
        """The committed state; rounds and folders of an unfinished step are removed."""
        self = cls.__new__(cls)
        self.spark, self.root, self.cols, self.stale = spark, root.rstrip("/"), ["s", "p", "o"], []
        # A row counts only if its write was committed as a whole.
        done = [n for n in _names(spark, f"{self.root}/manifest")
                if "_SUCCESS" in _names(spark, f"{self.root}/manifest/{n}")]
        if not done:
            raise ValueError(f"no materialisation at {root}")
        last = max(int(n.removeprefix("seq=")) for n in done)
        for n in _names(spark, f"{self.root}/manifest"):
            if int(n.removeprefix("seq=")) > last:
                _remove(spark, f"{self.root}/manifest/{n}")
        self.step = Step(**spark.read.schema(MANIFEST).json(f"{self.root}/manifest/seq={last}").first().asDict())
        self.seq = last + 1
        self.buckets, self.rounds, self.bytes = self.step.buckets, self.step.rounds, self.step.bytes
        self.path = f"{self.root}/{self.step.folder}"
        for n in _names(spark, self.root):
            if n.startswith("facts-") and n != self.step.folder:
                _remove(spark, f"{self.root}/{n}")
        for n in _names(spark, self.path):
            if n.startswith("rnd=") and int(n.removeprefix("rnd=")) >= self.rounds or n == "_temporary":
                _remove(spark, f"{self.path}/{n}")
        self.name = "entailer_facts_" + uuid.uuid4().hex
        _remember(spark, "table", self.name)
        spark.sql(f"CREATE TABLE {self.name} (s STRING, p STRING, o STRING, rnd INT) USING parquet "
                  f"PARTITIONED BY (rnd) CLUSTERED BY (s, p, o) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{self.path}'")
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        return self
