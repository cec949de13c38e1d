"""Ranks of rows without a window over the rows.

A window numbers a whole group in one task. Here rows are dealt out by ranges of the
order, so that a group that holds a third of them spreads over tasks; each task numbers
what it holds, and only the sizes of these runs, one row for a group and task, are
summed up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from entailer.operators.fixpoint import pin

TASK_BITS = 33  # of a number by ``monotonically_increasing_id``, below the task's


def ranked(rows: DataFrame, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``rank``: from 0 in ``order``, counted inside each group of ``within``.

    Equal rows get neighbouring ranks. The numbering is stored, so reading it again
    never changes it.
    """
    by = [*within, *order]
    placed = pin(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                 .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_task", F.shiftright("_at", TASK_BITS))
    runs = placed.groupBy(*within, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*within).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    keys = [*within, "_task"]
    starts = runs.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], (
        F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.lit(True)
    for i, c in enumerate(keys):  # a group may be named by null
        same &= F.col(c).eqNullSafe(F.col(f"_key{i}"))
    return placed.join(starts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("rank"))
