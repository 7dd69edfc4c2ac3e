"""The deterministic sampling plan as column expressions, exact in 64-bit integers.

A file of n bytes is sampled in k blocks so that no gap between blocks exceeds ``gap``, if that
reads less than the file and costs less when each read costs ``seek`` bytes more. A value that
would overflow counts as too much: the file is read in full.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX = (1 << 63) - 1
# Block size and seek cost in bytes by profile.
PROFILES = {"ssd": (64 << 10, 200_000), "hdd": (1 << 20, 1_440_000)}


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("bigint")


def profile_defaults(profile: Column) -> Column:
    """struct(block, seek) of a profile; null if it is unknown."""
    out = None
    for name, (block, seek) in PROFILES.items():
        value = F.struct(_long(block).alias("block"), _long(seek).alias("seek"))
        out = F.when(profile == name, value) if out is None else out.when(profile == name, value)
    return out


def n_samples(n: Column, gap: Column | int, block: Column | int, seek: Column | int) -> Column:
    """k, the number of sampled blocks; null if the file is to be read in full."""
    n, gap, block, seek = map(_long, (n, gap, block, seek))
    span, step = n - block, _sum(gap, block)
    k = _div(span, step) + F.when(span % step != 0, 1).otherwise(0) + 1
    all_read = k > _div(n - 1, block)
    dear = (seek > MAX - n) | (k > _div(_sum(seek, n) - 1, _sum(seek, block)))
    return F.when((span > block) & ~all_read & ~dear, k)


def _sum(x: Column, y: Column) -> Column:
    """x + y of nonnegative numbers, at most the largest number."""
    return F.least(x, MAX - y) + y


def _div(x: Column, y: Column) -> Column:
    """Integer division of nonnegative numbers, exact for 64 bits."""
    return F.call_function("div", x, y)


def offsets(n: Column, block: Column | int, k: Column) -> Column:
    """Starts of the k blocks, evenly from 0 to n - block, as an array; null if k is."""
    n, block = _long(n), _long(block)
    q, r = _div(n - block, k - 1), (n - block) % (k - 1)
    at = lambda i: i * q + _div((i.cast("decimal(38,0)") * r.cast("decimal(38,0)")), (k - 1).cast("decimal(38,0)")).cast("bigint")
    return F.when(k.isNotNull(), F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), at))


def read_bytes(n: Column, block: Column | int, k: Column) -> Column:
    """Bytes that the plan reads, at most the largest number."""
    return F.when(k.isNull(), _long(n)).when(k > _div(_long(MAX), _long(block)), _long(MAX)).otherwise(k * _long(block))


def entry_cost(kind: Column, n: Column, block: Column | int, seek: Column | int, k: Column, reused: Column | None = None) -> Column:
    """What an entry costs to read, in bytes: links and errors a seek, entries that are reused nothing."""
    cost = F.when(kind == "F", _sum(read_bytes(n, block, k), _long(seek))).otherwise(_long(seek))
    return cost if reused is None else F.when(reused, _long(0)).otherwise(cost)


def spans(at: Column, block: Column | int, merge_gap: Column | int) -> Column:
    """struct(n_spans, bytes_read): blocks nearer than ``merge_gap`` are read through."""
    block, merge_gap = _long(block), _long(merge_gap)
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(at) - 1, F.lit(1))), lambda i: F.get(at, i) - F.get(at, i - 1) - block)
    gaps = F.filter(gaps, lambda g: g.isNotNull())
    apart = F.filter(gaps, lambda g: g >= merge_gap)
    near = F.aggregate(F.filter(gaps, lambda g: g < merge_gap), _long(0), lambda x, g: x + g)
    return F.when(at.isNotNull(), F.struct((F.size(apart) + 1).cast("bigint").alias("n_spans"), (F.size(at) * block + near).cast("bigint").alias("bytes_read")))


def mode_line(fast: bool, gap: int = 0, block: int = 0, profile: str = "", seek: int = 0) -> str:
    """How digests were made; digests are comparable only if these lines are equal."""
    return f"fast gap={gap} block={block} profile={profile} seek_bytes={seek}" if fast else "full"
