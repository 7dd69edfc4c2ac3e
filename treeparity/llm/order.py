"""Ranks and running sums of an order, without a task that holds it.

The order is range-partitioned and written; what comes before a partition is one number for each,
and what comes before a row inside it is counted there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch

_IN_PARTITION = (1 << 33) - 1


def _placed(df: DataFrame, keys: list[str], scratch: Scratch, name: str, n_partitions: int, value: str | None) -> tuple[DataFrame, int]:
    """``df`` in order with at, part and start, the sum of value (rows, if null) before its part; and the sum of all."""
    sortable = [F.col(k).asc_nulls_first() for k in keys]
    placed = df.repartitionByRange(n_partitions, *sortable).sortWithinPartitions(*sortable).withColumn("at", F.monotonically_increasing_id())
    placed = scratch.table(placed, name).withColumn("part", F.shiftright("at", 33))
    found = placed.groupBy("part").agg((F.sum(value) if value else F.count("*")).alias("n")).collect()  # a number for each partition, not for each row
    starts, total = [], 0
    for p, n in sorted((r["part"], r["n"] or 0) for r in found):
        starts.append((p, total))
        total += n
    offsets = scratch.spark.createDataFrame(starts, "part bigint, start bigint")
    return placed.join(F.broadcast(offsets), "part"), total


def ranked(df: DataFrame, keys: list[str], scratch: Scratch, name: str, n_partitions: int) -> tuple[DataFrame, int]:
    """``df`` with its rank by ``keys`` as column rank, from 0, nulls first, and the number of rows."""
    found, total = _placed(df, keys, scratch, name, n_partitions, None)
    return found.withColumn("rank", F.col("start") + F.col("at").bitwiseAND(_IN_PARTITION)).drop("at", "part", "start"), total


def running(df: DataFrame, keys: list[str], value: str, scratch: Scratch, name: str, n_partitions: int) -> tuple[DataFrame, int]:
    """``df`` with the sum of ``value`` over the rows before as column before, and the sum of all."""
    found, total = _placed(df, keys, scratch, name, n_partitions, value)
    inside = F.sum(value).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("before", F.col("start") + F.coalesce(inside, F.lit(0))).drop("at", "part", "start"), total
