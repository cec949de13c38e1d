"""Join helpers: size-checked broadcast with a salted fallback.

Rule joins pair the large instance data (ABox) with small schema-derived
relations (TBox). The natural join keys (predicate, class) have few distinct
values, so a plain shuffle join on them would put a whole predicate such as
``rdf:type`` into a single task. The TBox side is therefore broadcast -- but
only after its size has been measured. Beyond the bound the join is *salted*:
each instance row gets a deterministic salt (a hash of the row, so task
retries see the same value) and the schema side is replicated once per salt,
which spreads every hot key over as many tasks as the session shuffles to
(``entailer.salt.buckets`` overrides).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD_BYTES = 48


@dataclass(frozen=True)
class Sized:
    """A frame plus its measured size and the broadcast decision."""

    df: DataFrame
    rows: int
    bytes: int
    broadcast: bool

    def side(self) -> DataFrame:
        return F.broadcast(self.df) if self.broadcast else self.df

    def map(self, fn) -> "Sized":
        """The same relation re-projected (renames keep the measured size)."""
        return Sized(fn(self.df), self.rows, self.bytes, self.broadcast)


def max_broadcast_bytes(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("entailer.broadcast.maxBytes", None)
    return int(conf) if conf else DEFAULT_MAX_BYTES


def _width(df: DataFrame):
    return sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in df.columns), F.lit(0))


def measure(df: DataFrame) -> Sized:
    """Count rows and string bytes of ``df`` in one aggregation job."""
    return measure_many([df])[0]


def measure_many(frames: list[DataFrame]) -> list[Sized]:
    """Measure several frames with one job (a tagged union, grouped by tag)."""
    tagged = [f.select(F.lit(i).alias("_i"), _width(f).alias("_w")) for i, f in enumerate(frames)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    got = {r["_i"]: (int(r["n"]), int(r["b"] or 0)) for r in union.groupBy("_i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("b")).collect()}
    out = []
    for i, f in enumerate(frames):
        rows, size = got.get(i, (0, 0))
        size += rows * ROW_OVERHEAD_BYTES
        out.append(Sized(f, rows, size, size <= max_broadcast_bytes(f)))
    return out


def salt_buckets(df: DataFrame) -> int:
    """One salt per shuffle partition: what the session was sized for."""
    spark = df.sparkSession
    conf = spark.conf.get("entailer.salt.buckets", None) or spark.conf.get(
        "spark.sql.shuffle.partitions", "200")
    return int(conf) if conf.isdigit() else spark.sparkContext.defaultParallelism


def join_small(big: DataFrame, small: "Sized | DataFrame", on: list[str],
               how: str = "inner") -> DataFrame:
    """Join instance data with a schema relation keyed on low-cardinality columns.

    Broadcast when the measured size allows, otherwise a salted shuffle join
    (``how`` is ``inner`` or ``left_semi``; both keep exact semantics because
    each instance row meets exactly one copy of each matching schema row).
    """
    sz = small if isinstance(small, Sized) else measure(small)
    if sz.broadcast:
        return big.join(F.broadcast(sz.df), on, how)
    n = salt_buckets(big)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(n)))
    copies = sz.df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return salted.join(copies, on + ["_salt"], how).drop("_salt")


def join_back(rows: DataFrame, aggregate: DataFrame, key: list[str]) -> DataFrame:
    """Join rows with an aggregate per ``key`` of the same rows, safe for hot keys.

    AQE splits a hot key only where both join sides are plain shuffles. An
    aggregate already lies partitioned by ``key``, which would stop that; the
    extra hash column makes Spark deal out both sides for the join.
    """
    k = F.xxhash64(*key)
    return rows.withColumn("_k", k).join(
        aggregate.withColumn("_k", k), ["_k", *key]).drop("_k")


def pin_bundle(frames: dict[str, DataFrame]) -> dict[str, Sized]:
    """Pin several schema relations with one write, measure them with one job.

    The relations are stored together as parquet in the checkpoint folder,
    partitioned by relation name (each is then read back with partition
    pruning), and sized by one grouped aggregation: a handful of rows, one
    per relation, reaches the driver.
    """
    from entailer.operators.fixpoint import state_path

    spark = next(iter(frames.values())).sparkSession
    width = max(len(df.columns) for df in frames.values())
    slots = [f"c{i}" for i in range(width)]
    parts = []
    for name, df in frames.items():
        cols = [F.col(c).cast("string").alias(slots[i]) for i, c in enumerate(df.columns)]
        pad = [F.lit(None).cast("string").alias(s) for s in slots[len(df.columns):]]
        parts.append(df.select(*cols, *pad, F.lit(name).alias("rel")))
    bundle = parts[0]
    for p in parts[1:]:
        bundle = bundle.unionByName(p)
    path = state_path(spark, "schema")
    bundle.write.partitionBy("rel").parquet(path)
    schema = ", ".join(f"{s} string" for s in slots) + ", rel string"
    stored = spark.read.schema(schema).parquet(path)
    width_expr = sum((F.coalesce(F.octet_length(F.col(s)), F.lit(0)) for s in slots), F.lit(0))
    sizes = {r["rel"]: (int(r["n"]), int(r["b"] or 0)) for r in stored.groupBy("rel").agg(
        F.count(F.lit(1)).alias("n"), F.sum(width_expr).alias("b")).collect()}
    limit = max_broadcast_bytes(stored)
    out = {}
    for name, df in frames.items():
        rel = stored.where(F.col("rel") == name).select(
            *[F.col(slots[i]).alias(c) for i, c in enumerate(df.columns)])
        rows, size = sizes.get(name, (0, 0))
        size += rows * ROW_OVERHEAD_BYTES
        out[name] = Sized(rel, rows, size, size <= limit)
    return out
