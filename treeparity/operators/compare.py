"""Comparison of trees and of content: full outer joins on the path under a first-match-wins order.

Entries have columns path, type, size, mtime, errno; digests path, type, hash, size, errno. A
path occurs once on a side. Every operator is one equi-join that
Catalyst plans as a sort-merge or broadcast join; nothing here collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELDS = ["type", "size", "errno", "hash"]


def classify(o: str = "o", d: str = "d") -> Column:
    """Status of a joined pair of structs, null for a match."""
    ot, dt = F.col(f"{o}.type"), F.col(f"{d}.type")
    return (
        F.when(ot == "E", "ERR-SRC")
        .when(dt.isNull(), "MISSING")
        .when(ot.isNull(), "EXTRA")
        .when(dt == "E", "ERR-DST")
        .when((ot == "L") != (dt == "L"), "TYPE")
        .when(F.col(f"{o}.size") != F.col(f"{d}.size"), "SIZE")
        .when(F.col(f"{o}.hash") != F.col(f"{d}.hash"), "HASH")
    )


def _side(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    fields = [(F.col(c) if c in df.columns else F.lit(None).cast("string" if c in ("type", "hash") else "bigint")).alias(c) for c in _FIELDS]
    return df.select(*keys, F.struct(*fields).alias(name))


def _pairs(origin: DataFrame, dest: DataFrame, keys: list[str]) -> DataFrame:
    joined = _side(origin, "o", keys).join(_side(dest, "d", keys), keys, "full_outer")
    return joined.withColumn("status", classify()).where("status is not null")


def hash_field(side: str) -> Column:
    """What a difference shows of one side: its digest, the error number, or ``-`` without an entry."""
    kind = F.col(f"{side}.type")
    return F.when(kind.isNull(), "-").when(kind == "E", F.col(f"{side}.errno").cast("string")).otherwise(F.col(f"{side}.hash"))


def section(status: str = "status") -> Column:
    """The side a difference of trees is listed under."""
    return F.when(F.col(status).isin("EXTRA", "ERR-DST"), "destination").otherwise("origin")


def compare_trees(origin: DataFrame, dest: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, section, status of every entry that differs; times and digests do not count."""
    keys = keys or ["path"]
    drop = [c for c in ("hash",) if c in origin.columns]
    return _pairs(origin.drop(*drop), dest.drop("hash"), keys).select(*keys, section().alias("section"), "status")


def compare_content(origin: DataFrame, dest: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, status, origin_hash, dest_hash of every digest that differs; F and S are both files."""
    keys = keys or ["path"]
    return _pairs(origin, dest, keys).select(*keys, "status", hash_field("o").alias("origin_hash"), hash_field("d").alias("dest_hash"))


def compare_star(origin: DataFrame, dests: DataFrame, names: DataFrame, content: bool = True) -> DataFrame:
    """One origin with many destinations, stacked in ``dests`` under the column dest.

    ``names`` holds a row for each destination, at most 64 of them, also for those without
    entries: the origin is read once and spread to them by a broadcast of these few names, and one
    join on (dest, path) compares all.
    """
    spread = origin.crossJoin(F.broadcast(names.select("dest")))
    return (compare_content if content else compare_trees)(spread, dests, ["dest", "path"])


def compare_positional(origin: DataFrame, dest: DataFrame) -> DataFrame:
    """Pairs entries by the column pos, under the origin's path: the comparison of single files."""
    joined = _side(origin, "o", ["pos", "path"]).join(_side(dest, "d", ["pos"]), "pos").withColumn("status", classify()).where("status is not null")
    return joined.select("pos", "path", "status", hash_field("o").alias("origin_hash"), hash_field("d").alias("dest_hash"))


def tree_changes(saved: DataFrame, current: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, status (ADDED, DELETED, CHANGED) between a saved and a current list of one tree; times count."""
    keys = keys or ["path"]
    cols = ["type", "size", "mtime", "errno"]
    a = saved.select(*keys, F.struct(*cols).alias("a"))
    b = current.select(*keys, F.struct(*cols).alias("b"))
    both = a.join(b, keys, "full_outer")
    same = (F.col("a.type") == F.col("b.type")) & F.when(F.col("a.type") == "E", F.col("a.errno").eqNullSafe(F.col("b.errno"))).otherwise(
        F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.mtime").eqNullSafe(F.col("b.mtime"))
    )
    status = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "DELETED").when(~same, "CHANGED")
    return both.withColumn("status", status).where("status is not null").select(*keys, "status")


def results_equal(a: str, b: str) -> Column:
    """Whether two digests of one entry are the same: type, and error number or size and hash."""
    same = F.col(f"{a}.size").eqNullSafe(F.col(f"{b}.size")) & F.col(f"{a}.hash").eqNullSafe(F.col(f"{b}.hash"))
    return (F.col(f"{a}.type") == F.col(f"{b}.type")) & F.when(F.col(f"{a}.type") == "E", F.col(f"{a}.errno").eqNullSafe(F.col(f"{b}.errno"))).otherwise(same)


def to_transfer(diff: DataFrame) -> DataFrame:
    """The differences whose paths are copied again: all but EXTRA and ERR-SRC."""
    return diff.where(~F.col("status").isin("EXTRA", "ERR-SRC"))


def kinds(listing: DataFrame, mode: str = "mode") -> DataFrame:
    """``listing`` with type F for regular files and L for links; directories and other kinds are null."""
    kind = F.expr(f"{mode} & 61440")  # the file-type bits of st_mode
    return listing.withColumn("type", F.when(kind == 0o100000, "F").when(kind == 0o120000, "L")).withColumn("ignored", ~kind.isin(0o100000, 0o120000, 0o040000))

