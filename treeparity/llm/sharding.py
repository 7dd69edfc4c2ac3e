"""Sharding by Hilbert-curve order, so that files can be pruned by several metadata columns.

Source, language, size and id are quantised to ``BITS`` bits each; documents are sorted by their
index on the curve through that space, and the order is cut into runs of equal row counts. Ranks
come from a range-partitioned, written order and the row counts of its partitions, one number
each; no partition holds more than its share of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import columns, order

BITS = 8
SHARDS = 24
#: Codes of at most so many values of a column are broadcast; with more, they are joined.
BROADCAST_VALUES = 10_000


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of each row of coordinates below 2**bits, by Skilling's transform."""
    x = [axes[:, i].astype(np.int64) for i in range(axes.shape[1])]
    n = len(x)
    for shift in range(bits - 1, 0, -1):
        q, low = 1 << shift, (1 << shift) - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        turn = np.where((x[n - 1] >> shift) & 1 == 1, turn ^ ((1 << shift) - 1), turn)
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ turn) >> bit) & 1)
    return out


def _curve(source: pa.Array, lang: pa.Array, size: pa.Array, doc: pa.Array) -> pa.Array:
    return pa.array(hilbert_index(np.stack([c.to_numpy(zero_copy_only=False) for c in (source, lang, size, doc)], axis=1)))


def _codes(values: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(value, code) of rows (value): values in order, null first, spread over 2**BITS by the rows before the middle of each."""
    counted = scratch.table(values.groupBy("value").agg(F.count("*").alias("n")), f"values-{name}")
    n = counted.count()
    found, total = order.running(counted, ["value"], "n", scratch, f"order-{name}", 1 + n // 200_000)
    codes = found.select("value", F.floor((F.col("before") + F.col("n") / 2) * (1 << BITS) / max(total, 1)).cast("int").alias("code"))
    return F.broadcast(codes) if n <= BROADCAST_VALUES else codes


def _scaled(value: Column, least, most) -> Column:
    top = (1 << BITS) - 1
    if least is None or least == most:
        return F.lit(0)
    share = (value.cast("double") - F.lit(float(least))) / F.lit(float(most) - float(least))
    return F.coalesce(F.floor(share * top).cast("int"), F.lit(0))


def hilbert_shards(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with size, text_crc32, shard and slot (columns of these names are replaced).

    ``keep`` names the other columns to return, all by default; what is not kept, such as a text
    of which only the size counts, is not shuffled.

    Counts of shards differ by one at most; slots count from 0 within a shard. Rows are ordered by
    curve index, id, size and checksum, nulls first; rows equal in all these are interchangeable.
    Null texts have no bytes. Missing columns source and lang count as null.
    """
    scratch = Scratch(spark, "shards")
    own = columns.others(docs, "size", "text_crc32", "shard", "slot")
    kept = [c for c in own if keep is None or c in keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = lambda name: (columns.column(name) if name in own else F.lit(None)).cast("string")
    ends = docs.agg(F.min(id_col), F.max(id_col), F.count("*")).first()
    rows = docs.select(columns.packed(kept), F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), of("source").alias("source"), of("lang").alias("lang"))
    for name in ("source", "lang"):
        codes = _codes(docs.select(of(name).alias("value")), scratch, name)
        rows = rows.join(codes, F.col(name).eqNullSafe(F.col("value")), "left").withColumnRenamed("code", f"{name}_code").drop("value", name)
    size_code = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.col("size")) * 8).cast("int"))
    curve = F.arrow_udf(_curve, "long")(F.coalesce("source_code", F.lit(0)), F.coalesce("lang_code", F.lit(0)), size_code, _scaled(F.col("id"), ends[0], ends[1]))
    rows = rows.select("row", "id", "size", "text_crc32", curve.alias("curve"))
    given = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n_partitions = max(1, min(-(-given // (32 << 20)), -(-ends[2] // 1000)))
    found, total = order.ranked(rows, ["curve", "id", "size", "text_crc32"], scratch, "order", n_partitions)
    found = found.withColumn("shard", F.expr(f"cast((rank * {shards}) div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * cast({max(total, 1)} as bigint) + {shards - 1}) div {shards}")
    return found.select(*columns.unpacked(kept), "size", "text_crc32", "shard", (F.col("rank") - first).alias("slot"))


def op7_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = hilbert_shards(spark, docs, keep=["doc_id"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
