"""A data source that lists directory trees: every file, link and unreadable entry, by bytes path.

Files, links and errors are rows F, L and E; other kinds (FIFOs, sockets, devices) are rows I and
directories that are not descended into for being excluded rows X, so that both can be counted.
Top levels are listed on the driver until there are enough directories to give each task some.
Paths must be visible to all executors.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path binary, type string, size bigint, mtime bigint, errno int, ino bigint"
#: Levels that the driver lists at most to find work for tasks.
LEVELS = 4


class _Part(InputPartition):
    """Directories to list alone and directories to walk, relative to the root."""

    def __init__(self, shallow: list[bytes], deep: list[bytes]):
        self.shallow, self.deep = shallow, deep


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.fsencode(options["root"]) if "root_hex" not in options else bytes.fromhex(options["root_hex"])
        self.file_mode = options.get("file_mode", "false").lower() == "true"
        self.one_fs = options.get("one_file_system", "false").lower() == "true"
        self.tasks = int(options.get("tasks", "32"))
        self.excluded = {tuple(map(int, x.split(":"))) for x in options.get("excluded", "").split(",") if x}

    def _row(self, rel: bytes, s: os.stat_result):
        kind = "F" if stat.S_ISREG(s.st_mode) else "L" if stat.S_ISLNK(s.st_mode) else "I"
        return (rel, kind, s.st_size, int(s.st_mtime // 1), None, s.st_ino)

    def _list(self, rel: bytes, device: int, rows: list, dirs: list[bytes]) -> None:
        """One directory: its rows, and the directories below it."""
        full = os.path.join(self.root, rel) if rel else self.root
        try:
            names = os.listdir(full)
        except OSError as e:
            if not rel:
                raise
            rows.append((rel, "E", None, None, e.errno, None))
            return
        for name in names:
            child = rel + b"/" + name if rel else name
            try:
                s = os.lstat(os.path.join(self.root, child))
            except OSError as e:
                rows.append((child, "E", None, None, e.errno, None))
                continue
            if not stat.S_ISDIR(s.st_mode):
                rows.append(self._row(child, s))
            elif (s.st_dev, s.st_ino) in self.excluded:
                rows.append((child, "X", None, None, None, s.st_ino))
            elif not self.one_fs or s.st_dev == device:
                dirs.append(child)

    def partitions(self):
        if self.file_mode:
            return [_Part([b""], [])]
        device = os.stat(self.root).st_dev
        os.listdir(self.root)  # an unreadable root ends the run
        shallow, deep = [], [b""]
        for _ in range(LEVELS):
            if len(deep) >= self.tasks:
                break
            below: list[bytes] = []
            for d in deep:
                self._list(d, device, [], below)
            shallow += deep
            deep = below
        parts = [_Part(shallow[i :: self.tasks], deep[i :: self.tasks]) for i in range(self.tasks)]
        return [p for p in parts if p.shallow or p.deep] or [_Part([], [])]

    def read(self, part: _Part) -> Iterator[tuple]:
        if self.file_mode:
            name = os.path.basename(self.root)
            try:
                s = os.stat(self.root)
                yield self._row(name, s)
            except OSError as e:
                yield (name, "E", None, None, e.errno, None)
            return
        device = os.stat(self.root).st_dev
        for rel in part.shallow:
            rows: list[tuple] = []
            self._list(rel, device, rows, [])
            yield from rows
        stack = list(part.deep)
        while stack:
            rows = []
            self._list(stack.pop(), device, rows, stack)
            yield from rows


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treeparity_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def scan(spark: SparkSession, root: bytes | str, excluded: list[tuple[int, int]] = (), file_mode: bool = False, one_file_system: bool = False, tasks: int = 32) -> DataFrame:
    """All rows of a tree; ``entries`` and ``ignored`` tell them apart."""
    spark.dataSource.register(TreeSource)
    options = {"root_hex": os.fsencode(root).hex(), "file_mode": str(file_mode), "one_file_system": str(one_file_system), "tasks": str(tasks), "excluded": ",".join(f"{d}:{i}" for d, i in excluded)}
    return spark.read.format("treeparity_tree").options(**options).load()


def entries(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("type").isin("F", "L", "E"))


def n_ignored(scanned: DataFrame) -> int:
    return scanned.where("type = 'I'").count()
