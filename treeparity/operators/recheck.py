"""Running again over only what differed: sets of paths by destination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recheck_sets(diff: DataFrame) -> DataFrame:
    """(dest, path) of every difference but EXTRA."""
    return diff.where("status <> 'EXTRA'").select("dest", "path").distinct()


def recheck_union(sets: DataFrame) -> DataFrame:
    """The origin's paths: those of any destination."""
    return sets.select("path").distinct()


def only(entries: DataFrame, paths: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Entries of these paths, before anything is read; Spark broadcasts the set if it is small."""
    keys = keys or ["path"]
    return entries.join(paths.select(*keys), keys, "left_semi")


def only_own(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Differences whose path is in their own destination's set."""
    return pairs.join(sets.select("dest", "path"), ["dest", "path"], "left_semi")


def gone(sets: DataFrame, entries: DataFrame) -> DataFrame:
    """Paths to check again that are in no tree any more."""
    return recheck_union(sets).join(entries.select("path"), "path", "left_anti")


def first_seen(rows: DataFrame, sides: list[str]) -> DataFrame:
    """(side, path) of each path under the first of ``sides``, in their order, that has it."""
    rank = F.array_position(F.array(*map(F.lit, sides)), F.col("side"))
    return rows.groupBy("path").agg(F.min_by("side", rank).alias("side")).select("side", "path")


def run_state(sides: DataFrame, by: list[str] | None = None) -> DataFrame:
    """State of a previous run from one row a side (has_run, has_hashes, finished, differs)."""
    facts = sides.groupBy(*(by or [])).agg(F.bool_or("has_run").alias("run"), F.bool_or("has_hashes").alias("hashes"), F.bool_and("finished").alias("finished"), F.bool_or("differs").alias("differs"))
    fresh = ~F.coalesce("run", F.lit(False)) & ~F.coalesce("hashes", F.lit(False))
    state = F.when(fresh, "FRESH").when(~F.coalesce("finished", F.lit(False)), "INTERRUPTED").when(F.col("differs"), "FINISHED_DIFF").otherwise("FINISHED_CLEAN")
    return facts.select(*(by or []), state.alias("state"))
