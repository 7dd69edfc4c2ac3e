"""Digests of content columns: of everything, of a sample, and of a link's target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def le64(n: Column) -> Column:
    """Eight little-endian bytes of a nonnegative integer."""
    digits = F.lpad(F.hex(n.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def full_digest(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def link_digest(target: Column) -> Column:
    return F.md5(target.cast("binary"))


def sampled_digest(content: Column, at: Column, block: int) -> Column:
    """Digest of the size and the sampled blocks; null where there is no sample."""
    raw = content.cast("binary")
    blocks = F.transform(at, lambda o: F.substring(raw, (o + 1).cast("int"), F.lit(block)))
    return F.when(at.isNotNull(), F.md5(F.aggregate(blocks, le64(F.octet_length(raw)), lambda x, b: F.concat(x, b))))


def content_digest(content: Column, at: Column, block: int) -> Column:
    """struct(type, hash): S with the digest of a sample where there is one, else F with the full one."""
    sampled = F.struct(F.lit("S").alias("type"), sampled_digest(content, at, block).alias("hash"))
    return F.when(at.isNotNull(), sampled).otherwise(F.struct(F.lit("F").alias("type"), full_digest(content).alias("hash")))
