"""Digests of real files, read on the executors: in full, by sample, or of a link's target."""

from __future__ import annotations

import errno
import hashlib
import os
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.sampling import MAX

CHUNK = 1 << 20
SCHEMA = "path binary, type string, hash string, size bigint, errno int, samples bigint, bytes_read bigint"


def plan(n: int, gap: int, block: int, seek: int) -> list[int] | None:
    """Offsets of the blocks to read, None for everything; the twin of the column expressions."""
    if n <= 2 * block or 2 * block > MAX:
        return None
    k = 2 if gap + block > MAX else -((block - n) // (gap + block)) + 1
    if k * block >= n or k * block > MAX or k * (seek + block) > MAX or seek + n > MAX or k * (seek + block) >= seek + n:
        return None
    return [i * (n - block) // (k - 1) for i in range(k)]


class Reader:
    """Reads spans of one file and counts what it has read."""

    def __init__(self, fd: int):
        self.fd, self.n_read = fd, 0

    def span(self, at: int, n: int, into=None) -> None:
        while n:
            part = os.pread(self.fd, min(n, CHUNK), at)
            if not part:
                raise OSError(errno.EIO, "the file became shorter")
            self.n_read += len(part)
            if into is not None:
                into.update(part)
            at, n = at + len(part), n - len(part)


def digest_file(path: bytes, fast: dict | None, merge_gap: int):
    """(type, hash, size, errno, samples, bytes_read) of a regular file."""
    reader = None
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NONBLOCK)
        try:
            s = os.fstat(fd)
            if not stat.S_ISREG(s.st_mode):
                raise OSError(errno.EINVAL, "not a regular file")
            reader, md5 = Reader(fd), hashlib.md5()
            at = plan(s.st_size, **fast) if fast else None
            if at is None:
                while part := os.read(fd, CHUNK):
                    reader.n_read += len(part)
                    md5.update(part)
                return ("F", md5.hexdigest(), reader.n_read, None, 0, reader.n_read)
            md5.update(s.st_size.to_bytes(8, "little"))
            end = -1
            for o in at:
                if 0 <= end and o - end < merge_gap:
                    reader.span(end, o - end)
                reader.span(o, fast["block"], md5)
                end = o + fast["block"]
            return ("S", md5.hexdigest(), s.st_size, None, len(at), reader.n_read)
        finally:
            os.close(fd)
    except OSError as e:
        return ("E", None, None, e.errno, 0, reader.n_read if reader else 0)


def digest_link(path: bytes):
    try:
        target = os.readlink(path)
        return ("L", hashlib.md5(target).hexdigest(), len(target), None, 0, len(target))
    except OSError as e:
        return ("E", None, None, e.errno, 0, 0)


def _digest(root: bytes, fast: dict | None, merge_gap: int, file_mode: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, kinds, errors = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for p, kind, e in zip(paths, kinds, errors, strict=True):
                full = root if file_mode else os.path.join(root, p)
                found.append(("E", None, None, e, 0, 0) if kind == "E" else digest_link(full) if kind == "L" else digest_file(full, fast, merge_gap))
            kinds_of = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds_of)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["path", "type", "hash", "size", "errno", "samples", "bytes_read"])

    return run


def digest_entries(entries: DataFrame, root: bytes, fast: dict | None = None, merge_gap: int = 1 << 16, file_mode: bool = False, tasks: int = 64) -> DataFrame:
    """A digest row for each entry (path, type, errno); ``fast`` holds gap, block and seek, or is None.

    Entries are dealt by hash to many tasks, so that large files do not meet in one; within a
    task they are in order of their inode.
    """
    if "ino" in entries.columns:
        entries = entries.repartition(tasks, "path").sortWithinPartitions("ino")
    return entries.select("path", "type", "errno").mapInArrow(_digest(root, fast, merge_gap, file_mode), SCHEMA)
