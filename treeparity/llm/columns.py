"""A caller's columns, whatever their names, beside columns of our own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import words


def others(df: DataFrame, *replaced: str) -> list[str]:
    """The columns of ``df`` that are not replaced, whatever their case."""
    return [c for c in df.columns if c.lower() not in replaced]


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free(names: list[str]) -> str:
    """A name that none of ``names`` is, whatever its case."""
    return "x" * (1 + max((len(n) for n in names), default=0))


def packed(names: list[str]) -> Column:
    """The caller's columns as one struct named row."""
    return (F.struct(*map(column, names)) if names else F.struct(F.lit(0).alias("none"))).alias("row")


def unpacked(names: list[str], row: str = "row") -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in names]


def numbered(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """The named columns as c0, c1 .., and more columns."""
    return df.select(*[column(c).alias(f"c{i}") for i, c in enumerate(names)], *more)


def mapped(df: DataFrame, names: list[str], f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str, *more: Column) -> DataFrame:
    """The named columns of ``df`` and those that ``f`` adds to them, in its batches of c0, c1 .. and ``more``."""
    given, new = numbered(df, names, *more), StructType.fromDDL(added).fields
    schema = StructType([StructField(x.name, x.dataType) for x in given.schema.fields[: len(names)]] + new)
    return given.mapInArrow(words.lean(f), schema).toDF(*names, *[x.name for x in new])
