"""A results directory: the run's record, its tables, states, archives and the lock."""

from __future__ import annotations

import datetime
import errno
import fcntl
import json
import os
import shutil
import struct
import uuid
from dataclasses import asdict, dataclass, field
from urllib.parse import quote

NAME = "results.treeparity"
# What a run leaves and what starting over removes; history and archives stay.
TABLES = ("trees", "trees-now", "placed", "digests", "tree_diff", "diff", "changes")
FILES = ("run.json", "summary.txt", "tree-changes.txt")
PREFIXES = ("transfer-", "command-", "tree-origin", "tree-destination", "tree-diff-", "hashes-", "diff-")


@dataclass
class Run:
    """What a run was asked for and how far it came."""

    started: str
    mode: str
    file_mode: bool
    roots: dict[str, str]
    recheck_of: str | None = None
    gate: dict[str, dict[str, int]] = field(default_factory=dict)
    journal: dict[str, list[str]] = field(default_factory=dict)
    finished: bool = False
    differs: bool = False

    def same_paths(self, other: Run) -> str | None:
        """The first side whose root differs, or ``mode``; None if a run can be resumed as the other."""
        for side in sorted(self.roots.keys() | other.roots.keys()):
            if self.roots.get(side) != other.roots.get(side):
                return side
        return None if (self.mode, self.file_mode) == (other.mode, other.file_mode) else "mode"


class Locked(RuntimeError):
    """Another process works in this directory."""


class Store:
    def __init__(self, output: str):
        if not os.path.isdir(output):
            raise FileNotFoundError(output)
        self.root = os.path.join(output, NAME)
        os.makedirs(self.root, exist_ok=True)
        self._lock = None

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def uri(self, *parts: str) -> str:
        """The path for Spark, which takes one without a scheme as its default file system's."""
        return "file://" + quote(os.path.abspath(self.path(*parts)))

    def lock(self, ignore: bool = False) -> str | None:
        """Hold the directory for the life of the run; a warning where it cannot be held."""
        self._lock = open(self.path("lock"), "a+")  # noqa: SIM115
        try:
            fcntl.lockf(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            if e.errno not in (errno.EACCES, errno.EAGAIN):
                return f"'{self.root}' is not locked, as its file system has no locks: {e.strerror}"
            if not ignore:
                holder = self.holder()
                self.unlock()
                raise Locked(f"another run works in '{self.root}'" + (f", process {holder}" if holder else "")) from e
        return None

    def holder(self) -> int | None:
        """The process that holds the lock, if it is on this machine."""
        asked = struct.pack("hhqqi4x", fcntl.F_WRLCK, 0, 0, 0, 0)
        try:
            kind, _, _, _, pid = struct.unpack("hhqqi4x", fcntl.fcntl(self._lock, fcntl.F_GETLK, asked))
        except (OSError, struct.error):
            return None
        return pid if kind != fcntl.F_UNLCK and pid > 0 else None

    def unlock(self) -> None:
        if self._lock:
            self._lock.close()
            self._lock = None

    def write(self, name: str, content: str) -> None:
        """Replace a small file as a whole."""
        with open(self.path(f"{name}.tmp"), "w") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self.path(f"{name}.tmp"), self.path(name))

    def save(self, run: Run) -> None:
        self.write("run.json", json.dumps(asdict(run), indent=1))

    def load(self) -> Run | None:
        if not os.path.exists(self.path("run.json")):
            return None
        with open(self.path("run.json")) as f:
            return Run(**json.load(f))

    def remember(self, run: Run) -> None:
        """Append to the history, which is never deleted."""
        with open(self.path("history.jsonl"), "a") as f:
            f.write(json.dumps({"started": run.started, "roots": run.roots, "mode": run.mode, "recheck_of": run.recheck_of}) + "\n")

    def state(self) -> str:
        run = self.load()
        if run is None:
            return "FRESH"
        if not run.finished:
            return "INTERRUPTED" if run.journal else "FRESH"
        return "FINISHED_DIFF" if run.differs else "FINISHED_CLEAN"

    def _own(self) -> list[str]:
        names = os.listdir(self.root)
        return [n for n in names if n in TABLES + FILES or n.startswith(PREFIXES)]

    def clean(self) -> None:
        for n in self._own():
            p = self.path(n)
            shutil.rmtree(p) if os.path.isdir(p) else os.unlink(p)

    def archive(self, run: Run) -> str:
        """Move a run's files into a folder named by its start; the name, with -2, -3 .. on a clash."""
        digits = "".join(c for c in run.started if c.isdigit())[:12]
        base = f"scan-{digits[4:8]}{digits[2:4]}{digits[:2]}{digits[8:]}" if len(digits) == 12 else "scan-unknown"
        for n in range(1, 100):
            name = base if n == 1 else f"{base}-{n}"
            try:
                os.mkdir(self.path(name))
            except FileExistsError:
                continue
            for f in self._own():
                os.rename(self.path(f), self.path(name, f))
            return name
        raise RuntimeError(f"too many archives named '{base}'")

    def new_chunk(self, side: str) -> str:
        """A name for a chunk of a journal; the run's record says which chunks count."""
        os.makedirs(self.path("digests", side), exist_ok=True)
        return f"chunk-{len(os.listdir(self.path('digests', side))):06d}-{uuid.uuid4().hex[:8]}"


def now() -> str:
    return datetime.datetime.now().strftime("%d/%m/%Y %H:%M")
