"""Order-dependent operators, without a window over a whole list.

A list is in the byte order of its paths. Positions come from a range-partitioned, written order
and the row counts of its partitions; neighbours meet in an equi-join on the position; prefixes
end at a minimum, which is one aggregate. So no task ever holds a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch

_IN_PARTITION = (1 << 33) - 1


def with_position(spark: SparkSession, entries: DataFrame, key: str = "path", by: list[str] | None = None, cost: str | None = None) -> DataFrame:
    """``entries`` with the column pos: 0, 1, 2 .. in order of ``key``, for each value of ``by`` of its own.

    ``by`` names columns of few values, such as the side. With ``cost``, the column spent is the sum
    of that column over the entries before.
    """
    by = by or []
    scratch = Scratch(spark, "order")
    placed = entries.repartitionByRange(*by, key).sortWithinPartitions(*by, key).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.table(placed, "placed").withColumn("_part", F.shiftright("_at", 33))
    total = F.sum(cost) if cost else F.lit(0)
    firsts = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.coalesce(total, F.lit(0)).alias("_cost"), F.min(F.col("_at").bitwiseAND(_IN_PARTITION)).alias("_first"))
    order = sorted(((tuple(r[b] or "" for b in by), r["_part"], r["_n"], r["_first"], r["_cost"], [r[b] for b in by]) for r in firsts.collect()))
    starts, seen = [], {}
    for value, part, n, first, spent, raw in order:  # a row for each partition and value, not for each entry
        rows, costs = seen.get(value, (0, 0))
        starts.append((part, *raw, rows - first, costs))
        seen[value] = rows + n, min(costs + spent, (1 << 63) - 1)
    fields = ", ".join(["_part bigint", *[f"`{b}` {dict(placed.dtypes)[b]}" for b in by], "_start bigint", "_spent bigint"])
    offsets = F.broadcast(spark.createDataFrame(starts, fields))
    found = placed.join(offsets, ["_part", *by]).withColumn("pos", F.col("_at").bitwiseAND(_IN_PARTITION) + F.col("_start"))
    if cost:
        inside = F.sum(cost).over(Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        found = found.withColumn("spent", F.col("_spent") + F.coalesce(inside, F.lit(0)))
    return found.drop("_at", "_part", "_start", "_spent")


def chunk_of(spent: Column, target: int) -> Column:
    """Number of the chunk that an entry falls into, by what the entries before it cost."""
    return F.call_function("div", spent, F.lit(max(1, target)).cast("bigint"))


def order_violations(lines: DataFrame, key: str = "path", by: list[str] | None = None) -> DataFrame:
    """Lines (pos, key) whose key is not greater than that of the line before; empty for a proper list."""
    by = by or []
    before = lines.select(*by, (F.col("pos") + 1).alias("pos"), F.col(key).alias("before"))
    return lines.join(before, [*by, "pos"]).where(F.col(key) <= F.col("before"))


def prefix(lines: DataFrame, good: str, by: list[str] | None = None) -> DataFrame:
    """The lines before the first, by pos, for which ``good`` is not true."""
    by = by or []
    bad = lines.where(~F.coalesce(F.expr(good), F.lit(False)))
    if by:
        stop = bad.groupBy(*by).agg(F.min("pos").alias("_stop"))
        return lines.join(stop, by, "left").where("_stop is null or pos < _stop").drop("_stop")
    return lines.crossJoin(bad.agg(F.min("pos").alias("_stop"))).where("_stop is null or pos < _stop").drop("_stop")


def good_prefix(kept: DataFrame, entries: DataFrame) -> int:
    """How many entries from the first on have exactly one row each in ``kept`` (pos)."""
    once = kept.groupBy("pos").agg(F.count("*").alias("n")).where("n = 1")
    stop = entries.select("pos").join(once, "pos", "left_anti").agg(F.min("pos")).first()[0]
    return entries.count() if stop is None else stop


def type_fits(entry: str, line: str):
    """Whether a journal line can be that of an entry: errors always, files by F or S, links by L."""
    e, j = F.col(entry), F.col(line)
    return (j == "E") | ((e == "F") & j.isin("F", "S")) | ((e == "L") & (j == "L"))


def resume_prefix(journal: DataFrame, entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The longest prefix of a journal that is worth keeping.

    journal: pos, path, type and valid (a complete, well-formed line); entries: pos, path, type. A
    line is kept if it and all before are valid and stand for the entry at their position.
    """
    by = by or []
    now = entries.select(*by, "pos", F.col("path").alias("_path"), F.col("type").alias("_type"))
    both = journal.join(now, [*by, "pos"], "left")
    good = F.col("valid") & F.col("_path").eqNullSafe(F.col("path")) & F.coalesce(type_fits("_type", "type"), F.lit(False))
    return prefix(both.withColumn("_good", F.coalesce(good, F.lit(False))), "_good", by).drop("_path", "_type", "_good")


def split_last(kept: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``kept`` with the flag verify, true for its last line, which is read again before it is trusted."""
    by = by or []
    if not by:
        return kept.crossJoin(kept.agg(F.max("pos").alias("_last"))).withColumn("verify", F.col("pos") == F.col("_last")).drop("_last")
    last = kept.groupBy(*by).agg(F.max("pos").alias("_last"))
    return kept.join(last, by).withColumn("verify", F.col("pos") == F.col("_last")).drop("_last")


def to_read(entries: DataFrame, kept: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Entries whose digest is not reused: those after the prefix, and its last."""
    by = by or []
    trusted = split_last(kept, by).where("not verify").select(*by, "path")
    return entries.join(trusted, [*by, "path"], "left_anti")
