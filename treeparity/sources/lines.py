"""Line and list files: an ordered sink of raw bytes, the text formats, and positions of lines read.

The sink writes a part for each task and joins them in order on commit, by a rename in the end;
nothing passes through the driver's memory. Paths must be visible to all executors.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import text


@dataclass
class _Written(WriterCommitMessage):
    part: int
    path: str


class _OrderedWriter(DataSourceWriter):
    def __init__(self, options):
        self.to = options["to"]
        self.end = bytes.fromhex(options.get("end", "0a"))
        self.head, self.foot = (bytes.fromhex(options.get(k, "")) for k in ("head", "foot"))
        self.run = uuid.uuid4().hex

    def write(self, rows) -> _Written:
        part = TaskContext.get().partitionId()
        path = f"{self.to}.{self.run}.{part:06d}.{TaskContext.get().attemptNumber()}"
        with open(path, "wb") as f:
            for row in rows:
                f.write(bytes(row[0]))
                f.write(self.end)
        return _Written(part, path)

    def commit(self, messages) -> None:
        temporary = f"{self.to}.{self.run}.tmp"
        parts = sorted((m for m in messages if m), key=lambda m: m.part)
        with open(temporary, "wb") as out:
            out.write(self.head)
            for m in parts:
                with open(m.path, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
                os.unlink(m.path)
            out.write(self.foot)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, self.to)

    def abort(self, messages) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.unlink(m.path)


class OrderedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treeparity_lines"

    def writer(self, schema, overwrite) -> _OrderedWriter:
        return _OrderedWriter(dict(self.options))


def write_ordered(df: DataFrame, to: str, end: bytes = b"\n", head: bytes = b"", foot: bytes = b"") -> None:
    """Write the only column of an ordered ``df`` (binary) with ``end`` after each row."""
    df.sparkSession.dataSource.register(OrderedLines)
    df.write.format("treeparity_lines").mode("append").options(to=to, end=end.hex(), head=head.hex(), foot=foot.hex()).save()


def tree_line(path: str = "path") -> Column:
    """TYPE SIZE MTIME PATH, or E ERRNO - PATH, as bytes."""
    p = text.escape(text.as_chars(F.col(path)))
    line = F.when(F.col("type") == "E", F.concat_ws(" ", F.lit("E"), F.col("errno"), F.lit("-"), p)).otherwise(F.concat_ws(" ", "type", "size", "mtime", p))
    return text.as_bytes(line)


def hash_line(path: str = "path") -> Column:
    """TYPE HASH SIZE PATH, or E ERRNO - PATH, as bytes."""
    p = text.escape(text.as_chars(F.col(path)))
    line = F.when(F.col("type") == "E", F.concat_ws(" ", F.lit("E"), F.col("errno"), F.lit("-"), p)).otherwise(F.concat_ws(" ", "type", "hash", "size", p))
    return text.as_bytes(line)


def diff_line(path: str = "path") -> Column:
    """STATUS ORIGIN-HASH DESTINATION-HASH PATH, as bytes."""
    return text.as_bytes(F.concat_ws(" ", "status", "origin_hash", "dest_hash", text.escape(text.as_chars(F.col(path)))))


def status_line(path: str = "path") -> Column:
    return text.as_bytes(F.concat_ws(" ", "status", text.escape(text.as_chars(F.col(path)))))


class BadList(ValueError):
    """A file that is not the list it should be."""


#: Lists by kind: their version, the columns of a record and its line.
VERSION = 1
_LINES = {"tree": tree_line, "hashes": hash_line, "diff": diff_line, "tree-diff": status_line, "changes": status_line}


def _header(kind: str, pairs: list[tuple[str, str]]) -> bytes:
    return _comments([(f"treeparity {kind}", str(VERSION)), *pairs])


def _comments(pairs: list[tuple[str, str]]) -> bytes:
    """Lines ``# key: value``; values are escaped as paths are."""
    plain = lambda v: v.encode("utf-8", "surrogateescape").replace(b"\\", b"\\\\").replace(b"\n", b"\\n").replace(b"\r", b"\\r")
    return b"".join(b"# " + k.encode() + b": " + plain(v) + b"\n" for k, v in pairs)


def write_list(rows: DataFrame | None, kind: str, to: str, head: list[tuple[str, str]], foot: list[tuple[str, str]] | None = None) -> None:
    """A text list: header, records in byte order of their paths, footer; replaced as a whole."""
    if rows is None:
        with open(f"{to}.tmp", "wb") as f:
            f.write(_header(kind, head) + _comments(foot or []))
        os.replace(f"{to}.tmp", to)
        return
    write_ordered(rows.orderBy("path").select(_LINES[kind]()), to, head=_header(kind, head), foot=_comments(foot or []))


def write_sections(parts: list[tuple[str, DataFrame]], kind: str, to: str, head: list[tuple[str, str]]) -> None:
    """A text list with a part for each section, in order, under a line ``## section``."""
    rows = None
    for i, (name, part) in enumerate(parts):
        title = part.sparkSession.createDataFrame([(i, 0, b"", f"## {name}".encode())], "part int, row int, path binary, line binary")
        found = title.unionByName(part.select(F.lit(i).alias("part"), F.lit(1).alias("row"), "path", _LINES[kind]().alias("line")))
        rows = found if rows is None else rows.unionByName(found)
    write_ordered(rows.orderBy("part", "row", "path").select("line"), to, head=_header(kind, head))


def _head(path: str) -> list[tuple[str, str]]:
    """The comment lines before the first other line, as pairs."""
    found = []
    with open(path, "rb") as f:
        for raw in f:
            line = raw.rstrip(b"\n").decode("utf-8", "surrogateescape")
            if not line.startswith("# "):
                break
            key, _, value = line[2:].partition(": ")
            found.append((key, re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), value)))
    return found


def read_list(spark: SparkSession, path: str, kind: str, expected: dict[str, str] | None = None) -> DataFrame:
    """The records of a text list, checked: version, the header values asked for, every line and the order.

    Lists of trees and hashes have (pos, type, size, mtime, errno, hash, path); lists of differences
    have (pos, status, path). Raises ``BadList``.
    """
    head = _head(path)
    if not head or head[0] != (f"treeparity {kind}", str(VERSION)):
        raise BadList(f"{path}: not a list of kind {kind}, version {VERSION}")
    with open(path, "rb") as f:
        f.seek(-1, os.SEEK_END)
        if f.read() != b"\n":
            raise BadList(f"{path}: the last line has no end")
    for key, value in (expected or {}).items():
        if dict(head).get(key) != value:
            raise BadList(f"{path}: {key} is {dict(head).get(key)!r} and not {value!r}")
    raw = read_lines(spark, path)
    if kind in ("tree", "hashes"):
        rows = parse_list(raw, kind == "hashes")
        keys = ["pos"]
    else:
        rows, keys = _parse_status(raw, kind == "diff"), ["section", "pos"]
    if not rows.where("not valid").isEmpty():
        raise BadList(f"{path}: line {rows.where('not valid').agg(F.min('pos')).first()[0]} of the records is malformed")
    before = rows.select(*[F.col(k) for k in keys if k != "pos"], (F.col("pos") + 1).alias("pos"), F.col("path").alias("before"))
    if not rows.join(before, keys).where("path <= before").isEmpty():
        raise BadList(f"{path}: not in order")
    return rows.drop("valid")


def _parse_status(raw: DataFrame, hashes: bool) -> DataFrame:
    """(pos, section, status, origin_hash, dest_hash, path, valid) of a list of differences."""
    sections = raw.where(F.col("line").startswith("## ")).select(F.col("pos").alias("at")).collect()  # one for each side
    section = F.lit(0)
    for r in sections:
        section = section + (F.col("pos") > r["at"]).cast("int")
    data = raw.where(~F.col("line").startswith("#")).withColumn("section", section)
    shape = r"(?s)^([A-Z-]+) ([^ ]+) ([^ ]+) (.+)$" if hashes else r"(?s)^([A-Z-]+) (.+)$"
    part = lambda i: F.regexp_extract("line", shape, i)
    path = text.as_bytes(text.unescape(part(4 if hashes else 2)))
    found = data.select("pos", "section", part(1).alias("status"), *([part(2).alias("origin_hash"), part(3).alias("dest_hash")] if hashes else []), path.alias("path"))
    return found.withColumn("valid", (F.col("status") != "") & F.col("path").isNotNull())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text file: positions from 0, lines as one character a byte.

    A line's position is the number of lines in the file's blocks before, one number a block, and
    its place in its block; only that of a last line without an end is not told apart.
    """
    raw = spark.read.option("lineSep", "\n").text("file://" + quote(os.path.abspath(path))).select(F.expr("cast(value as binary)").alias("raw"), F.col("_metadata.file_block_start").alias("_block"))
    raw = raw.withColumn("_at", F.monotonically_increasing_id())
    blocks = raw.groupBy("_block").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect()
    starts, seen = [], 0
    for r in sorted(blocks, key=lambda r: r["_block"]):
        starts.append((r["_block"], seen - r["first"]))
        seen += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_block bigint, _start bigint"))
    return raw.join(offsets, "_block").select((F.col("_at") + F.col("_start")).alias("pos"), text.as_chars(F.col("raw")).alias("line"))


def parse_list(lines: DataFrame, hashes: bool) -> DataFrame:
    """(pos, type, size, mtime, errno, hash, path, valid) of a list's record lines, positions from 0.

    Header lines come first; a comment after the first record ends the data.
    """
    comment = F.col("line").startswith("#")
    first = lines.where(~comment).agg(F.min("pos").alias("_first"))
    stop = lines.where(comment).crossJoin(first).where("pos > _first").agg(F.min("pos").alias("_stop"))
    data = lines.crossJoin(first).crossJoin(stop).where("pos >= _first and (_stop is null or pos < _stop)")
    r = data.withColumn("r", text.parse_record(F.col("line"), hashes))
    error = F.col("r.type") == "E"
    return r.select(
        (F.col("pos") - F.col("_first")).alias("pos"),
        "r.type",
        F.when(~error, F.col("r.num")).alias("size"),
        "r.mtime",
        F.when(error, F.col("r.num")).cast("int").alias("errno"),
        "r.hash",
        text.as_bytes(F.col("r.path")).alias("path"),
        F.col("r").isNotNull().alias("valid"),
    )
