"""A whole run: scan, compare trees, digest what passed, compare content, report; again, if need be.

A destination whose tree differs in any way is never read, and one that fails does not stop the
others. Digests are made in path order, in chunks of about equal cost; each chunk is committed to the
run's record before the next. A resumed run keeps the rows that stand for the current entries from
the first on, reads the last of them again, and makes the rest, whatever the chunks were.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import sampling
from ..operators import compare, ordered, recheck, report
from ..sources import content, lines, tree
from .store import Run, Store, now

ORIGIN = "origin"
#: A side is digested in so many chunks at most, none of which costs less than MIN_CHUNK bytes.
CHUNKS = 64
MIN_CHUNK = 1 << 30
MAX_DESTINATIONS = 64
_DIGEST_COLUMNS = ["path", "type", "hash", "size", "errno", "samples", "bytes_read"]
#: What a failing side raises: errors of Spark, of its tasks and of the file system.
_FAILURES = (Exception,)


class Refused(ValueError):
    """The run cannot start as asked for; ``state`` is that of an earlier run which is in the way."""

    def __init__(self, why: str, state: str | None = None):
        super().__init__(why)
        self.state = state


@dataclass
class RunResult:
    exit_code: int
    summary: list[str]
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    commands: dict[str, str] = field(default_factory=dict)
    statuses: dict[str, int] = field(default_factory=dict)
    reused: dict[str, int] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)
    results: str = ""


def _clean(path: bytes) -> bytes:
    return os.path.normpath(os.path.join(os.getcwdb(), path)).replace(b"//", b"/")


def side_names(n: int) -> list[str]:
    return ["destination"] if n == 1 else [f"destination-{i + 1}" for i in range(n)]


def _quote(path: bytes) -> str:
    return "'" + path.decode("utf-8", "surrogateescape").replace("'", "'\\''") + "'"


def _text(path: bytes) -> str:
    return path.decode("utf-8", "surrogateescape")


class _Engine:
    def __init__(self, spark: SparkSession, origin, dests, output, file_mode, fast, gap, block, profile, one_file_system, merge_gap, on_existing, parallelism, chunk_cost, ignore_lock, progress):
        if not 1 <= len(dests) <= MAX_DESTINATIONS:
            raise Refused(f"1 to {MAX_DESTINATIONS} destinations are needed")
        self.spark, self.file_mode, self.one_fs, self.merge_gap = spark, file_mode, one_file_system, merge_gap
        self.tasks, self.chunk_cost, self.on_existing, self.ignore_lock = parallelism, chunk_cost, on_existing, ignore_lock
        self.progress = progress or (lambda line: None)
        self.dests = side_names(len(dests))
        self.roots = {ORIGIN: _clean(os.fsencode(origin))} | {n: _clean(os.fsencode(d)) for n, d in zip(self.dests, dests, strict=True)}
        self.failures: dict[str, str] = {}
        seen: dict[tuple[int, int], str] = {}
        for side, root in self.roots.items():
            if os.path.isdir(root) == file_mode or not os.path.exists(root):
                raise Refused(f"{side}: not a {'file' if file_mode else 'directory'}: {root!r}")
            key = (s := os.stat(root)).st_dev, s.st_ino
            if key in seen:
                raise Refused(f"{side} and {seen[key]} are the same")
            seen[key] = side
        if profile not in sampling.PROFILES:
            raise Refused(f"unknown profile '{profile}'")
        default_block, seek = sampling.PROFILES[profile]
        block = block or default_block
        if gap < 1 or block < 512:
            raise Refused("a gap of 1 byte and a block of 512 bytes at least are needed")
        self.seek, self.block, self.gap = seek, block, gap
        self.fast = {"gap": gap, "block": block, "seek": seek} if fast else None
        self.mode = sampling.mode_line(fast, gap, block, profile, seek)
        self.store = Store(output)
        own = os.stat(self.store.root)
        self.excluded = {side: (os.stat(root).st_dev, os.stat(root).st_ino) for side, root in self.roots.items()}
        self.own = own.st_dev, own.st_ino

    # Tables and lists.

    def read(self, *parts: str) -> DataFrame:
        return self.spark.read.parquet(self.store.uri(*parts))

    def write(self, df: DataFrame, *parts: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.store.uri(*parts))
        return self.read(*parts)

    def guarded(self, side: str, work: Callable[[], object]):
        """The result of ``work``; a destination that fails is set aside, an origin that fails ends the run."""
        try:
            return work()
        except _FAILURES as e:
            if side == ORIGIN:
                raise
            self.failures[side] = str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__
            return None

    def working(self, names: list[str]) -> list[str]:
        return [n for n in names if n not in self.failures]

    def name(self, kind: str, side: str) -> str:
        return f"{kind}-{side}.txt"

    # Trees.

    def scan(self, side: str) -> DataFrame:
        excluded = [self.own, *(key for s, key in self.excluded.items() if s != side)]
        return tree.scan(self.spark, self.roots[side], excluded, self.file_mode, self.one_fs, self.tasks)

    def tree(self, side: str, where: str = "trees") -> DataFrame:
        return self.read(where, side)

    def scan_all(self, where: str) -> dict[str, int]:
        """Write every side's rows and, at the first scan, its list; the numbers of ignored ones."""
        ignored = {}
        for side in self.roots:

            def one(side=side):
                found = self.write(self.scan(side), where, side)
                if where == "trees":
                    out = [("root", _text(self.roots[side])), *(("excluded", _text(bytes(r["path"]))) for r in found.where("type = 'X'").orderBy("path").collect())]  # at most the other roots
                    lines.write_list(tree.entries(found), "tree", self.store.path(self.name("tree", side)), out)
                return tree.n_ignored(found)

            if (n := self.guarded(side, one)) is not None:
                ignored[side] = n
        return ignored

    def saved_tree(self, side: str) -> DataFrame:
        """The list of a side's entries as it was written, checked."""
        return lines.read_list(self.spark, self.store.path(self.name("tree", side)), "tree", {"root": _text(self.roots[side])})

    def entries(self, side: str, sets: DataFrame | None) -> DataFrame:
        found = tree.entries(self.tree(side))
        if sets is None:
            return found
        own = recheck.recheck_union(sets) if side == ORIGIN else sets.where(F.col("dest") == side)
        return recheck.only(found, own)

    def stack(self, of, names: list[str]) -> DataFrame:
        out = None
        for n in names:
            x = of(n).withColumn("dest", F.lit(n))
            out = x if out is None else out.unionByName(x)
        return out

    def names(self, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in names], "dest string")

    def star(self, of, names: list[str], content_stage: bool, sets: DataFrame | None) -> DataFrame:
        """Differences of all named destinations at once; rechecks only look at a destination's own paths."""
        if self.file_mode:
            base = of(ORIGIN).withColumn("pos", F.lit(0))
            found = self.stack(lambda n: compare.compare_positional(base, of(n).withColumn("pos", F.lit(0))), names).drop("pos")
            return found if content_stage else found.select("dest", "path", compare.section().alias("section"), "status")
        found = compare.compare_star(of(ORIGIN), self.stack(of, names), self.names(names), content_stage)
        return found if sets is None else recheck.only_own(found, sets)

    # Digests.

    def placed(self, side: str, entries: DataFrame) -> tuple[DataFrame, int]:
        """Entries with pos and chunk, stored by chunk, and their number."""
        n = F.coalesce("size", F.lit(0))
        k = sampling.n_samples(n, self.gap, self.block, self.seek) if self.fast else F.lit(None).cast("bigint")
        costly = entries.withColumn("cost", sampling.entry_cost(F.col("type"), n, self.block, self.seek, k))
        found = ordered.with_position(self.spark, costly, cost="cost")
        total = found.agg(F.sum("cost"), F.count("*")).first()
        target = max((total[0] or 0) // CHUNKS, self.chunk_cost)
        rows = found.withColumn("chunk", ordered.chunk_of(F.col("spent"), target)).drop("spent", "cost")
        rows.write.mode("overwrite").partitionBy("chunk").parquet(self.store.uri("placed", side))
        return self.spark.read.schema(rows.schema).parquet(self.store.uri("placed", side)), total[1]

    def digest_side(self, run: Run, side: str, entries: DataFrame, resume: bool) -> tuple[int, str]:
        """Digest in chunks of path order; rows reused and how the last kept one fared."""
        placed, n = self.placed(side, entries)
        start, check = 0, "nothing to keep"
        if resume:
            start, check = self.keep(run, side, placed)
        reused = start
        chunks = [r[0] for r in placed.where(F.col("pos") >= start).select("chunk").distinct().orderBy("chunk").collect()]
        began = time.monotonic()
        for i, chunk in enumerate(chunks):
            todo = placed.where((F.col("chunk") == chunk) & (F.col("pos") >= start))
            self.commit(run, side, self.digest(todo, side))
            if i + 1 == len(chunks) or time.monotonic() - began >= 2:
                self.progress(f"{side}: chunk {i + 1} of {len(chunks)}")
                began = time.monotonic()
        done = self.journal(run, side)
        have = done.agg(F.count("*"), F.countDistinct("pos")).first() if done else (0, 0)
        if tuple(have) != (n, n):
            raise RuntimeError(f"{side}: {have[0]} digests at {have[1]} places for {n} entries")
        return reused, check

    def keep(self, run: Run, side: str, placed: DataFrame) -> tuple[int, str]:
        """Rows that are kept of an earlier journal, which then holds these alone.

        Kept are those of the first entries, each with one valid row that is of its path and type;
        the last is read again, and dropped if it is not the same any more.
        """
        old = self.journal(run, side)
        if old is None:
            return 0, "nothing to keep"
        valid = F.col("path").isNotNull() & ((F.col("type") == "E") & F.col("errno").isNotNull() | F.col("hash").rlike("^[0-9a-f]{32}$") & F.col("size").isNotNull())
        good = ordered.resume_prefix(old.withColumn("valid", valid), placed.select("pos", "path", "type")).select("pos")
        n = start = ordered.good_prefix(good, placed)
        check = "nothing to keep"
        if n:
            last = old.where(F.col("pos") == n - 1)
            again = self.digest(placed.where(F.col("pos") == n - 1), side)
            both = last.select(F.struct(*_DIGEST_COLUMNS).alias("a"), "path").join(again.select(F.struct(*_DIGEST_COLUMNS).alias("b"), "path"), "path")
            same = not both.where(compare.results_equal("a", "b")).isEmpty()
            start, check = (n, "the last one still holds") if same else (n - 1, "the last one changed and is made again")
        if old.count() != start:
            kept = [self.write_chunk(side, old.where(F.col("pos") < start))] if start else []
            run.journal[side] = kept
            self.store.save(run)
        return start, check

    def write_chunk(self, side: str, rows: DataFrame) -> str:
        chunk = self.store.new_chunk(side)
        rows.write.mode("overwrite").parquet(self.store.uri("digests", side, chunk))
        return chunk

    def commit(self, run: Run, side: str, rows: DataFrame) -> None:
        """Write rows as a chunk; only when the record names it is it there."""
        run.journal.setdefault(side, []).append(self.write_chunk(side, rows))
        self.store.save(run)

    def journal(self, run: Run, side: str) -> DataFrame | None:
        chunks = [c for c in run.journal.get(side, []) if os.path.isdir(self.store.path("digests", side, c))]
        if not chunks:
            return None
        rows = self.spark.read.parquet(*[self.store.uri("digests", side, c) for c in chunks])
        return rows if {"pos", *_DIGEST_COLUMNS} <= set(rows.columns) else None

    def digest(self, entries: DataFrame, side: str) -> DataFrame:
        """Digests of entries with their positions."""
        made = content.digest_entries(entries, self.roots[side], self.fast, self.merge_gap, self.file_mode, self.tasks)
        return made.join(entries.select("path", "pos"), "path")

    def publish(self, run: Run, side: str) -> None:
        out = [("root", _text(self.roots[side])), ("mode", self.mode), ("started", run.started)]
        lines.write_list(self.journal(run, side), "hashes", self.store.path(self.name("hashes", side)), out, [("finished", now())])

    # The run.

    def decide(self) -> tuple[str, Run | None]:
        state, old = self.store.state(), self.store.load()
        want = self.on_existing
        if state == "FRESH" or want == "force":
            return "start", None
        if want == "resume" and state == "INTERRUPTED":
            if side := old.same_paths(Run(now(), self.mode, self.file_mode, self._roots_text())):
                raise Refused(f"the run to resume differs: {side}")
            return "resume", old
        if want == "recheck" and state == "FINISHED_DIFF":
            if self.file_mode or old.file_mode or old.roots != self._roots_text():
                raise Refused("the run to check again had other paths")
            if old.mode != self.mode:
                raise Refused(f"the run to check again was made as: {old.mode}")
            return "recheck", old
        raise Refused(f"there are results of a run in state {state}; resume, force or recheck as fits", state)

    def _roots_text(self) -> dict[str, str]:
        return {s: _text(r) for s, r in self.roots.items()}

    def run(self) -> RunResult:
        if warning := self.store.lock(self.ignore_lock):
            self.progress(warning)
        try:
            return self._run()
        finally:
            self.store.unlock()

    def _sets(self, archive: str) -> DataFrame:
        """Paths by destination of an archived run's lists: differences in content, or of trees where those differed."""
        parts = []
        for d in self.dests:
            for kind in ("diff", "tree-diff"):
                listed = self.store.path(archive, self.name(kind, d))
                if os.path.isfile(listed):
                    found = lines.read_list(self.spark, listed, kind, {"mode": self.mode} if kind == "diff" else {})
                    parts.append(found.select(F.lit(d).alias("dest"), "path", "status"))
        found = parts[0] if parts else self.spark.createDataFrame([], "dest string, path binary, status string")
        for p in parts[1:]:
            found = found.unionByName(p)
        return recheck.recheck_sets(found)

    def _run(self) -> RunResult:
        began = time.time()
        what, old = self.decide()
        sets = None
        if what == "recheck":
            archive = self.store.archive(old)
            run = Run(now(), self.mode, self.file_mode, self._roots_text(), recheck_of=archive)
            sets = self._sets(archive)
        elif what == "resume":
            run = old
            sets = self._sets(old.recheck_of) if old.recheck_of else None
        else:
            self.store.clean()
            run = Run(now(), self.mode, self.file_mode, self._roots_text())
        if what != "resume":
            self.store.save(run)
            self.store.remember(run)
        out = RunResult(0, [f"results in {self.store.root}"], results=self.store.root, failures=self.failures)
        if run.recheck_of:
            out.summary.append(f"{recheck.recheck_union(sets).count()} path(s) of {run.recheck_of} are checked again")

        ignored = self.scan_all("trees-now" if what == "resume" else "trees")
        if what == "resume" and (n := self.changes()):
            out.summary.append(f"{n} change(s) in the trees since the run began; nothing was compared")
            out.exit_code = 2
            return out
        if what != "resume" or not run.gate:
            run.gate = self.gate(run, sets)
            self.store.save(run)
        passed = [d for d in self.working(self.dests) if not any(run.gate.get(d, {"": 1}).values())]
        for side in [ORIGIN, *passed] if passed else []:

            def one(side=side):
                reused, check = self.digest_side(run, side, self.entries(side, sets), what == "resume")
                self.publish(run, side)
                return reused, check

            if (kept := self.guarded(side, one)) is not None:
                out.reused[side] = kept[0]
                if what == "resume":
                    out.summary.append(f"{side}: {kept[0]} digest(s) kept, {kept[1]}")
        passed = self.working(passed)
        self._report(run, out, passed, ignored, sets, began)
        run.finished = True
        run.differs = out.exit_code in (1, 3, 4)
        self.store.save(run)
        self.store.write("summary.txt", "\n".join(out.summary) + "\n")
        return out

    def changes(self) -> int:
        """Write what differs between the saved lists and the trees now; the number of such entries."""
        found = self.stack(lambda s: compare.tree_changes(self.saved_tree(s), tree.entries(self.tree(s, "trees-now"))), self.working(list(self.roots))).withColumnRenamed("dest", "side")
        found = self.write(found, "changes")
        rows, head = [], []
        for s in self.working(list(self.roots)):
            rows.append((s, found.where(F.col("side") == s)))
            head.append((s, _text(self.roots[s])))
        lines.write_sections(rows, "changes", self.store.path("tree-changes.txt"), head)
        return found.count()

    def gate(self, run: Run, sets: DataFrame | None) -> dict[str, dict[str, int]]:
        """Compare trees; the counts by destination, zeros for those that may be read."""
        names = self.working(self.dests)
        if not names:
            return {}
        found = self.write(self.star(lambda s: self.entries(s, sets), names, False, sets), "tree_diff")
        for d in names:
            parts = [(s, found.where((F.col("dest") == d) & (F.col("section") == s))) for s in (ORIGIN, "destination")]
            lines.write_sections(parts, "tree-diff", self.store.path(self.name("tree-diff", d)), [(ORIGIN, _text(self.roots[ORIGIN])), ("destination", _text(self.roots[d]))])
        rows = report.status_counts(found, self.names(names), schemas.TREE_ORDER).collect()
        return {r["dest"]: {s: r[s] for s in schemas.TREE_ORDER} for r in rows}

    def _report(self, run: Run, out: RunResult, passed: list[str], ignored: dict[str, int], sets: DataFrame | None, began: float) -> None:
        counts, stats, read = {d: c for d, c in run.gate.items() if d in self.working(self.dests)}, {}, {}
        hashed = [ORIGIN, *passed] if passed else []
        digests = lambda side: self.journal(run, side) if self.journal(run, side) is not None else self.spark.createDataFrame([], f"{content.SCHEMA}, pos bigint")
        if passed:
            diff = self.write(self.star(digests, passed, True, sets), "diff")
            counts |= {r["dest"]: {s: r[s] for s in schemas.CONTENT_ORDER} for r in report.status_counts(diff, self.names(passed)).collect()}
            stacked = self.stack(digests, hashed).withColumnRenamed("dest", "side")
            stats = {r["side"]: r for r in report.side_stats(stacked).collect()}
            read = {r["side"]: r[1] or 0 for r in stacked.groupBy("side").agg(F.sum("bytes_read")).collect()}
        for side in self.roots:
            if side in self.failures:
                out.summary.append(f"{side}: failed, {self.failures[side]}")
                continue
            s = stats.get(side)
            n = s["entries"] if s else 0 if side in hashed else self.entries(side, sets).count()
            text = f"{side}: {n} entries, {ignored.get(side, 0)} of other kinds"
            if side in hashed:
                kinds = f" ({s['full']} in full, {s['sampled']} by sample, {s['links']} links, {s['errors']} unreadable)" if s else ""
                text += f", {report.human_bytes(read.get(side, 0))} read{kinds}"
            out.summary.append(text)
        if passed:
            seconds = int(time.time() - began)
            tenths = sum(read.values()) // (seconds * 100_000) if seconds else None
            out.summary.append(f"time: {seconds} s" + (f" at {tenths // 10}.{tenths % 10} MB/s" if seconds else ""))
            if self.fast:
                m = report.sample_metrics(stacked, self.block).agg(*[F.sum(c).alias(c) for c in ("files", "samples", "sample_bytes", "total")]).first()
                if m["files"]:
                    c = m["sample_bytes"] // (m["total"] // 10000) if m["total"] >= 10000 else m["sample_bytes"] * 10000 // m["total"]
                    out.summary.append(f"by sample: {m['files']} file(s), {m['samples']} blocks, {report.human_bytes(m['sample_bytes'])} of {report.human_bytes(m['total'])}, {c // 100}.{c % 100:02d} % covered")
        facts = []
        for d in self.dests:
            if d in self.failures:
                facts.append((d, True, False, 0, 0))
                continue
            c, of_content = counts[d], d in passed
            told = f"{d}: " + ("content" if of_content else "tree") + (" equal" if not any(c.values()) else " differs, " + ", ".join(f"{n} {s}" for s, n in c.items() if n))
            out.summary.append(told)
            unread = sum(stats[s]["errors"] for s in (ORIGIN, d) if s in stats)
            errors = unread + c["ERR-SRC"] + c["ERR-DST"] if of_content else 0
            facts.append((d, False, not of_content, errors, sum(c.values())))
            if of_content:
                rows = diff.where(F.col("dest") == d)
                head = [(ORIGIN, _text(self.roots[ORIGIN])), ("destination", _text(self.roots[d])), ("mode", self.mode)]
                lines.write_list(rows, "diff", self.store.path(self.name("diff", d)), head, [("finished", now()), ("result", told), *(("side", x) for x in out.summary if x.startswith((f"{ORIGIN}:", f"{d}:")) and x != told)])
            self._command(d, c, of_content, out)
        each = report.exit_statuses(self.spark.createDataFrame(facts, "dest string, failed boolean, tree_differs boolean, errors bigint, differences bigint"))
        out.statuses = {r["dest"]: r["status"] for r in each.collect()}
        out.exit_code = report.run_status(each).first()[0]
        out.counts = counts
        if sets is not None:
            every = self.stack(lambda s: tree.entries(self.tree(s)).select("path"), self.working(list(self.roots)))
            if n := recheck.gone(sets, every).count():
                out.summary.append(f"{n} path(s) to check again are in no tree any more")

    def _command(self, d: str, c: dict[str, int], content_stage: bool, out: RunResult) -> None:
        """Write the list of paths to copy and the command, if there is anything to copy."""
        roots = [_quote(self.roots[s] + (b"" if self.file_mode else b"/")) for s in (ORIGIN, d)]
        if not content_stage:
            if c["EXTRA"] + c["MISSING"] + c["SIZE"] + c["TYPE"]:
                out.commands[d] = " ".join(["rsync -a", *(["--delete-after"] if c["EXTRA"] else []), *(["-x"] if self.one_fs else []), *self._excludes(d), *roots])
            return
        copies = compare.to_transfer(self.read("diff").where(F.col("dest") == d))
        command = ""
        if self.file_mode:
            command = " ".join(["rsync -a -I", *roots]) if not copies.isEmpty() else ""
        else:
            listed = self.store.path(f"transfer-{d}.lst")
            lines.write_ordered(copies.select("path").orderBy("path"), listed, end=b"\0")
            if os.path.getsize(listed):
                command = " ".join([f"rsync -a -I --from0 --files-from={_quote(os.fsencode(listed))}", *roots])
        self.store.write(f"command-{d}.txt", command + "\n" if command else "")
        if command:
            out.commands[d] = command

    def _excludes(self, d: str) -> list[str]:
        """Filters for directories that a scan did not go into, each once."""
        rows = self.stack(lambda s: self.tree(s).where("type = 'X'").select("path"), [ORIGIN, d]).withColumnRenamed("dest", "side")
        found = [bytes(r["path"]) for r in recheck.first_seen(rows, [ORIGIN, d]).orderBy(F.col("side") == d, "path").collect()]  # at most a few roots inside others
        pattern = lambda p: b"/" + b"".join(b"\\" + bytes([b]) if b in b"*?[\\" else bytes([b]) for b in p) + b"/"
        return [f"--exclude={_quote(pattern(p))}" for p in found]


def run_comparison(
    spark: SparkSession, origin, dests, output=".", file_mode=False, fast=False, gap=64 << 20, block=0, profile="ssd", one_file_system=False,
    merge_gap=1 << 16, on_existing=None, parallelism=32, chunk_cost=MIN_CHUNK, ignore_lock=False, progress=None,
) -> RunResult:
    """Compare the content of one tree (or file) with that of 1 to 64 others.

    ``on_existing`` says what to do about results of an earlier run: None refuses, ``force`` starts
    over, ``resume`` goes on with an interrupted run, ``recheck`` reads only what differed.
    ``progress`` is called with a line now and then. Exit codes: 0 equal, 1 content differs, 2 failed
    or changed, 3 unreadable entries, 4 trees differ.
    """
    return _Engine(spark, origin, list(dests), output, file_mode, fast, gap, block, profile, one_file_system, merge_gap, on_existing, parallelism, chunk_cost, ignore_lock, progress).run()
