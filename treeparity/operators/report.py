"""Counts, statistics, exit status and commands of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text

#: Statuses a destination may end with, the most severe last.
SEVERITY = [0, 1, 3, 4, 2]


def status_counts(diff: DataFrame, names: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A row for each destination of ``names`` with the number of differences by status, zeros included."""
    order = order or schemas.CONTENT_ORDER
    counted = diff.groupBy("dest").agg(*[F.count_if(F.col("status") == s).alias(s) for s in order])
    return names.select("dest").join(counted, "dest", "left").na.fill(0, order)


def side_stats(digests: DataFrame) -> DataFrame:
    """Numbers of entries by kind for each side."""
    kind = lambda k: F.count_if(F.col("type") == k)
    return digests.groupBy("side").agg(F.count("*").alias("entries"), kind("F").alias("full"), kind("S").alias("sampled"), kind("L").alias("links"), kind("E").alias("errors"))


def coverage(read: Column, total: Column) -> Column:
    """Hundredths of a percent, in integers that do not overflow."""
    return F.when(total >= 10000, F.call_function("div", read, F.call_function("div", total, F.lit(10000)))).when(total > 0, F.call_function("div", read * 10000, total))


def sample_metrics(digests: DataFrame, block: int) -> DataFrame:
    """For each side: sampled files, samples, bytes in samples, size of those files and coverage."""
    s = F.col("type") == "S"
    out = digests.groupBy("side").agg(
        F.count_if(s).alias("files"),
        F.coalesce(F.sum(F.when(s, F.col("samples"))), F.lit(0)).cast("bigint").alias("samples"),
        F.coalesce(F.sum(F.when(s, F.col("samples") * block)), F.lit(0)).cast("bigint").alias("sample_bytes"),
        F.coalesce(F.sum(F.when(s, F.col("size"))), F.lit(0)).cast("bigint").alias("total"),
    )
    return out.withColumn("coverage", coverage(F.col("sample_bytes"), F.col("total")))


def throughput(digests: DataFrame, seconds: int) -> DataFrame:
    """One row: bytes read by all sides and tenths of a MB (10**6 bytes) a second; null at 0 seconds."""
    total = digests.agg(F.coalesce(F.sum("bytes_read"), F.lit(0)).cast("bigint").alias("bytes_read"))
    rate = F.call_function("div", F.col("bytes_read"), F.lit(seconds * 100_000).cast("bigint")) if seconds > 0 else F.lit(None).cast("bigint")
    return total.withColumn("tenths_mb_s", rate)


def exit_statuses(counts: DataFrame) -> DataFrame:
    """dest and status of rows (dest, failed, tree_differs, errors, differences).

    2 failed, 4 trees differ, 3 errors, 1 differences, 0 equal; the first that holds.
    """
    status = F.when(F.col("failed"), 2).when(F.col("tree_differs"), 4).when(F.col("errors") > 0, 3).when(F.col("differences") > 0, 1).otherwise(0)
    return counts.select("dest", status.alias("status"))


def run_status(statuses: DataFrame) -> DataFrame:
    """The most severe status of all destinations."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITY) for x in (s, i)]), F.col("status"))
    return statuses.agg(F.coalesce(F.max_by("status", rank), F.lit(0)).alias("status"))


def suggest_flags(counts: DataFrame) -> DataFrame:
    """dest and the flags of the command that would make the trees equal; null if only errors differ."""
    any_change = F.col("EXTRA") + F.col("MISSING") + F.col("SIZE") + F.col("TYPE") > 0
    return counts.select("dest", F.when(any_change, F.when(F.col("EXTRA") > 0, "rsync -a --delete-after").otherwise("rsync -a")).alias("command"))


def content_command(listed: Column, origin: Column, dest: Column) -> Column:
    """The command that copies the paths of a list file again."""
    return F.concat(F.lit("rsync -a -I --from0 --files-from="), text.shell_quote(listed), F.lit(" "), text.shell_quote(origin), F.lit(" "), text.shell_quote(dest))


def human_bytes(v: int) -> str:
    """One decimal, cut off; the driver's twin of the column function."""
    units, u, rest = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"], 0, 0
    while v >= 1024 and u < 6:
        v, rest, u = v // 1024, v % 1024, u + 1
    return f"{v} B" if not u else f"{v}.{rest * 10 // 1024} {units[u]}"
