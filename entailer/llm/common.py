"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entailer.operators.fixpoint import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers (once per context)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="entailer-")) / "entailer.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH_BYTES, BATCH_BYTES = "67108864b", 8 << 20  # Spark's default; ours


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package available to the workers.

    Unless the session says otherwise, an Arrow batch holds about 8 MiB, so that
    long texts do not make large batches; workers return freed memory after
    each task.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH_BYTES_CONF, None) in (None, DEFAULT_BATCH_BYTES):
        spark.conf.set(BATCH_BYTES_CONF, str(BATCH_BYTES))

    def task(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def with_text(docs: DataFrame, keep: list[str], *more: Column) -> tuple[DataFrame, str]:
    """Columns ``keep`` and ``more`` with the text as a string, and its column name.

    The text is not carried twice where ``keep`` already holds it.
    """
    if "text" in keep and dict(docs.dtypes)["text"] == "string":
        return docs.select(*keep, *more), "text"
    return docs.select(*keep, F.col("text").cast("string").alias("_text"), *more), "_text"


def schema_of(df: DataFrame, columns: list[str]) -> str:
    """DDL of some columns, each followed by a comma."""
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in columns)
