"""Lineage cutting, set difference of facts, and the semi-naive loop state.

Recursive rules run as driver loops of DataFrame jobs. Intermediate results
are written as parquet tables into ``spark.checkpoint.dir`` (a shared folder
on a cluster) and read back, so a lost executor never forces recomputation of
earlier rounds, the logical plan does not grow with the number of rounds, and
every read-back has fresh attribute ids (safe to self-join).

What a call stores stays until :func:`release_state` (or the end of a
:func:`state_scope`) drops it: results are read from it lazily.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stored state of each application, oldest first: ("table" | "path", name).
_state: dict[str, list[tuple[str, str]]] = {}
# The folder of each application that proved to be shared.
_shared: dict[str, str] = {}
TRIAL_TASKS_PER_CORE = 2


def _single_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in ``local[...]`` mode.

    A ``file:`` folder of a real cluster may be mounted on every machine or be local
    to each: rows that the executors write there tell, once per application. If no
    folder is set, or it is local, state goes to the warehouse, held to the same trial.
    (``entailer.checkpoint.sharedFileSystem=true`` vouches for both without a trial.)
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        current = sc.getConf().get("spark.checkpoint.dir", None)
        if not current and _single_machine(sc.master):
            current = tempfile.mkdtemp(prefix="entailer-ckpt-")
        if current:
            sc.setCheckpointDir(current)
            current = sc.getCheckpointDir()
    vouched = sc.getConf().get("entailer.checkpoint.sharedFileSystem", "false") == "true"

    def holds(folder: str) -> bool:
        if not folder.startswith("file:") or sc.master.startswith("local") or vouched:
            return True
        return _shared.get(sc.applicationId) == folder or _is_shared(spark, folder)

    if not (current and holds(current)):
        warehouse = sc.getConf().get("spark.sql.warehouse.dir", None)
        other = f"{warehouse.rstrip('/')}/entailer-state" if warehouse else None
        if not (other and holds(other)):
            fault = f"{current} is local to each machine" if current else "spark.checkpoint.dir is not set"
            raise RuntimeError(f"{fault}: set spark.checkpoint.dir to a shared folder (HDFS, S3, a mount)")
        sc.setCheckpointDir(other)
        current = sc.getCheckpointDir()
    _shared[sc.applicationId] = current
    return current


def _is_shared(spark: SparkSession, folder: str) -> bool:
    """Whether all rows that tasks write to ``folder`` are found there again.

    Each machine of an unshared folder keeps its part files to itself, or cannot write at all.
    """
    n = TRIAL_TASKS_PER_CORE * max(spark.sparkContext.defaultParallelism, 1)
    path = f"{folder.rstrip('/')}/trial-{uuid.uuid4().hex}"
    _remember(spark, "path", path)
    try:
        spark.range(0, n, 1, n).write.parquet(path)
        return spark.read.schema("id long").parquet(path).count() == n
    except (Py4JJavaError, PySparkException):
        return False


def _remember(spark: SparkSession, kind: str, name: str) -> None:
    _state.setdefault(spark.sparkContext.applicationId, []).append((kind, name))


def _drop(spark: SparkSession, kind: str, name: str) -> None:
    if kind == "table":
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    else:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _forget(spark: SparkSession, kind: str, name: str) -> None:
    """Drop one table or folder before its scope ends."""
    _state[spark.sparkContext.applicationId].remove((kind, name))
    _drop(spark, kind, name)


def release_state(spark: SparkSession, keep: int = 0) -> None:
    """Drop stored tables and folders, newest first, down to the first ``keep``.

    Frames that read them become unusable: write results before.
    """
    held = _state.get(spark.sparkContext.applicationId, [])
    while len(held) > keep:
        _drop(spark, *held.pop())


@contextmanager
def state_scope(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, all state that was stored inside."""
    before = len(_state.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release_state(spark, before)


def state_path(spark: SparkSession, name: str) -> str:
    """A new path for state in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _remember(spark, "path", path)
    return path


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Re-project with new attribute ids (and optionally new names).

    Needed before self-joins of checkpointed frames, whose attribute ids
    would otherwise collide.
    """
    cols = df.columns
    names = names or tuple(cols)
    return df.select(*[F.col(c).alias(n) for c, n in zip(cols, names)])


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
COMPRESSION = "zstd"


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """State is written once and read from its files: what the write shuffled goes at its end.

    Left to the driver's garbage collector, the shuffles of all rounds pile up on disk.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def _write_state(df: DataFrame, path: str) -> None:
    with _writing(df.sparkSession):
        df.write.option("compression", COMPRESSION).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as parquet in the checkpoint folder and read it back.

    Unlike ``Dataset.checkpoint`` the result carries no physical-partitioning
    metadata bound to old attribute ids, so it can be self-joined freely; it
    is also columnar, compressed and filterable at the scan.
    """
    spark = df.sparkSession
    path = state_path(spark, "pinned")
    _write_state(df, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def pinned(df: DataFrame) -> Iterator[DataFrame]:
    """:func:`pin` for the time of a block: what is read from it must be stored by then."""
    spark = df.sparkSession
    path = state_path(spark, "pinned")
    try:
        _write_state(df, path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _forget(spark, "path", path)


def store_in_place(df: DataFrame, buckets: int, *cols: str) -> DataFrame:
    """Store ``df`` bucketed on ``cols`` without moving rows, and read it back.

    For rows that lie together by ``cols`` already: each task writes one file for
    every bucket that it holds. Joins and groups on ``cols`` then read them in place.
    """
    spark = df.sparkSession
    name = "entailer_rows_" + uuid.uuid4().hex
    path = state_path(spark, name)
    _remember(spark, "table", name)
    (df.write.format("parquet").bucketBy(min(buckets, MAX_BUCKETS), *cols)
     .option("path", path).saveAsTable(name))
    return spark.table(name)


def new_facts(candidates: DataFrame, known: DataFrame, on: Sequence[str] | None = None,
              partitions: int | None = None) -> DataFrame:
    """Distinct candidate rows that are not in ``known`` (U3 "subtract").

    A left-anti join on every column: keeps the left side's rows whose key is
    absent on the right. Both sides are hash-partitioned on the full row, so
    no single key can concentrate the work. With ``partitions`` the candidates
    are dealt out to that many, which lines up with a :class:`FactStore` of as
    many buckets: the known side is then read in place, without an exchange.
    """
    on = list(on or candidates.columns)
    if partitions:
        candidates = candidates.repartition(partitions, *on)
    return candidates.dropDuplicates(on).join(known.select(*on), on=on, how="left_anti")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


MAX_BUCKETS = 100_000  # what Spark allows a table
DEFAULT_BUCKET_BYTES = 32 * 1024 * 1024
SMALL_BYTES = 1024 * 1024
OUTGROWN = 4
HASHED_FROM = 4 << 30  # known bytes from which to sort them costs more than to store the candidates
HASHED_BYTES, HASHED_ROW = 64 * 1024 * 1024, 48  # candidates of a bucket that are hashed; overhead of a row


def _target(spark: SparkSession) -> int:
    conf = spark.conf.get("entailer.bucket.targetBytes", None)
    return int(conf) if conf else DEFAULT_BUCKET_BYTES


def bucket_count(spark: SparkSession, size_bytes: int) -> int:
    """Buckets of a fixpoint table that holds ``size_bytes``.

    About ``entailer.bucket.targetBytes`` (32 MiB) per bucket, without a cap,
    and at least one per core so that writes and scans stay parallel; a table
    of under 1 MiB has one. Independent of ``spark.sql.shuffle.partitions``:
    joins against the table deal out the other side to as many partitions.
    """
    if size_bytes < SMALL_BYTES:
        return 1
    return max(spark.sparkContext.defaultParallelism, -(-size_bytes // _target(spark)))


class RoundTable:
    """A growing set of rows, one parquet folder per round (``rnd=k``).

    Reading any range of rounds is one scan with partition pruning, so plans
    do not grow with the number of rounds.
    """

    def __init__(self, spark: SparkSession, cols: Sequence[str]):
        self.spark, self.cols = spark, list(cols)
        self.path = state_path(spark, "rounds")
        self.rounds = 0
        self.schema: str | None = None

    def add(self, df: DataFrame) -> DataFrame:
        df = df.select(*self.cols)
        if self.schema is None:
            self.schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", rnd int"
        k = self.rounds
        _write_state(df, f"{self.path}/rnd={k}")
        self.rounds += 1
        return self.where(F.col("rnd") == k)

    def where(self, cond) -> DataFrame:
        stored = self.spark.read.schema(self.schema).parquet(self.path)
        return stored.where(cond).select(*self.cols)

    def upto(self, k: int) -> DataFrame:
        """Rounds ``0..k``."""
        return self.where(F.col("rnd") <= k)

    def all(self) -> DataFrame:
        return self.where(F.lit(True))


class FactStore:
    """The growing fact set of a fixpoint, as a table in the checkpoint folder.

    Each round's new facts are appended as one partition (``rnd = k``) of a
    parquet table bucketed on all fact columns. Reading one round is a
    partition-pruned scan; reading everything known is a bucketed scan whose
    partitioning matches the anti-join of :func:`new_facts`, so stored rows
    are never shuffled again. When the set outgrows its buckets
    (``OUTGROWN`` times the target size each) it is dealt out to more.
    Committed files survive the loss of the executors that wrote them.
    """

    def __init__(self, spark: SparkSession, cols: Sequence[str] = ("s", "p", "o"), size_bytes: int = 0):
        self.spark, self.cols = spark, list(cols)
        self.buckets = bucket_count(spark, size_bytes)
        self.bytes = 0
        self.rounds = 0
        self._create()

    def _create(self) -> None:
        self.name = "entailer_facts_" + uuid.uuid4().hex
        self.path = self._folder()
        _remember(self.spark, "table", self.name)

    def _folder(self) -> str:
        return state_path(self.spark, self.name)

    def _write(self, df: DataFrame) -> None:
        df = df.sortWithinPartitions(*self.cols)  # as anti-joins leave them: half as large
        with _writing(self.spark):
            (df.write.mode("append").format("parquet").option("compression", COMPRESSION).partitionBy("rnd")
             .bucketBy(self.buckets, *self.cols).option("path", self.path).saveAsTable(self.name))

    def add(self, df: DataFrame, size_bytes: int = 0, placed: bool = False) -> DataFrame:
        """Append ``df`` as the next round; return that round, read back.

        A bucketed write has every task write one file per bucket it holds:
        rows are dealt out by bucket first unless they are ``placed`` already
        (the output of :func:`new_facts` with this table's bucket count).
        """
        k = self.rounds
        if not placed:
            df = df.repartition(self.buckets, *self.cols)
        self._write(df.select(*self.cols).withColumn("rnd", F.lit(k)))
        self.rounds += 1
        self.grown(size_bytes)
        return self.where(F.col("rnd") == k)

    def grown(self, size_bytes: int) -> None:
        """Note that ``size_bytes`` were added; deal out anew if there are too few buckets."""
        self.bytes += size_bytes
        wanted = bucket_count(self.spark, self.bytes)
        if wanted > OUTGROWN * self.buckets:
            old = self.spark.table(self.name)
            self.buckets = wanted
            self._create()
            self._write(old.repartition(self.buckets, *self.cols))

    def new(self, candidates: DataFrame, known: DataFrame) -> DataFrame:
        """:func:`new_facts` against this table's rows, aligned with its buckets."""
        return new_facts(candidates.select(*self.cols), known, partitions=self.buckets)

    def add_new(self, candidates: DataFrame, known: DataFrame) -> DataFrame:
        """Append the candidates that are not ``known`` as the next round; read it back.

        After the first round the known rows outnumber the candidates, so that to sort
        them in every round would cost most once they are many. The distinct candidates are stored by bucket
        and measured; where a bucket's fit in memory, they are hashed, the known rows pass
        by unsorted, and candidates that were met go.
        """
        if self.rounds < 2 or self.bytes < HASHED_FROM:
            return self.add(self.new(candidates, known), placed=True)
        rows = candidates.select(*self.cols).repartition(self.buckets, *self.cols).dropDuplicates(self.cols)
        with self._placed(rows) as found:
            size = found.agg(F.count(F.lit(1)), F.sum(sum(F.octet_length(c) for c in self.cols))).first()
            if (size[1] or 0) + size[0] * HASHED_ROW > HASHED_BYTES * self.buckets:
                return self.add(found.join(known, self.cols, "left_anti"), placed=True)
            met = fresh(known.join(found.hint("shuffle_hash"), self.cols, "left_semi"))
            return self.add(found.join(met.hint("shuffle_hash"), self.cols, "left_anti"), placed=True)

    @contextmanager
    def _placed(self, rows: DataFrame) -> Iterator[DataFrame]:
        """Rows that lie by bucket, stored so for the time of a block."""
        name = "entailer_candidates_" + uuid.uuid4().hex
        path = state_path(self.spark, name)
        _remember(self.spark, "table", name)
        try:
            with _writing(self.spark):
                (rows.write.format("parquet").option("compression", COMPRESSION)
                 .bucketBy(self.buckets, *self.cols).option("path", path).saveAsTable(name))
            yield self.spark.table(name)
        finally:
            _forget(self.spark, "table", name)
            _forget(self.spark, "path", path)

    def where(self, cond) -> DataFrame:
        return self.spark.table(self.name).where(cond).select(*self.cols)

    def upto(self, k: int) -> DataFrame:
        """Rounds ``0..k``."""
        return self.where(F.col("rnd") <= k)

    def all(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.cols)
