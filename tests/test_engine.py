"""Whole runs on random trees, against an oracle of a few lines of Python."""

import hashlib
import os
import random
import shutil
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from treeparity import cli
from treeparity.plans import engine
from treeparity.plans.engine import Refused, run_comparison
from treeparity.plans.store import Locked, Store
from treeparity.sources import content, lines, tree

NAMES = [b"plain", b"with space", b"new\nline", b"back\\slash", b"\xfe\x80", b"*", b"it's", b"~", b"#", b"## x"]


def random_tree(r, n):
    """{path: content or ('link', target)}; some directories are empty."""
    found = {}
    for _ in range(n):
        path = b"/".join(r.choice(NAMES) + b"%d" % r.randrange(4) for _ in range(r.randrange(1, 4)))
        if any(p == path or p.startswith(path + b"/") or path.startswith(p + b"/") for p in found):
            continue
        found[path] = ("link", r.choice([b"away", b"%d" % r.randrange(5)])) if r.random() < 0.15 else r.randbytes(r.choice([0, 1, 90, 3000]))
    return found


def put(root, files):
    root = os.fsencode(root)
    os.makedirs(root, exist_ok=True)
    for path, value in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        if isinstance(value, tuple):
            os.symlink(value[1], full)
        else:
            with open(full, "wb") as f:
                f.write(value)
    return root


def edited(r, files, tree_too):
    """A copy with changed content and, if asked for, changed entries."""
    out = dict(files)
    for p in sorted(files):
        v, dice = files[p], r.random()
        if dice < 0.2 and not isinstance(v, tuple) and v:
            i = r.randrange(len(v))
            out[p] = v[:i] + bytes([v[i] ^ 1]) + v[i + 1 :]
        elif tree_too and dice < 0.3:
            del out[p]
        elif tree_too and dice < 0.4 and not isinstance(v, tuple):
            out[p] = v + b"more"
        elif tree_too and dice < 0.45:
            out[p] = ("link", b"t") if not isinstance(v, tuple) else b"file"
        elif tree_too and dice < 0.5:
            out[p + b".added"] = b"new"
    return out


def oracle(a, b):
    """(statuses of the tree, statuses of the content) by path."""
    kind, size = lambda v: isinstance(v, tuple), lambda v: len(v[1]) if isinstance(v, tuple) else len(v)
    trees, contents = {}, {}
    for p in a.keys() | b.keys():
        if p not in b:
            trees[p] = "MISSING"
        elif p not in a:
            trees[p] = "EXTRA"
        elif kind(a[p]) != kind(b[p]):
            trees[p] = "TYPE"
        elif size(a[p]) != size(b[p]):
            trees[p] = "SIZE"
        elif a[p] != b[p]:
            contents[p] = "HASH"
    return trees, contents


def count(statuses):
    return {s: list(statuses.values()).count(s) for s in set(statuses.values())}


def real(counts):
    return {s: n for s, n in counts.items() if n}


@pytest.fixture
def place(tmp_path):
    (tmp_path / "out").mkdir()
    return tmp_path


def run(spark, place, dests, **options):
    return run_comparison(spark, place / "o", [place / d for d in dests], str(place / "out"), parallelism=3, **options)


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, place, seed):
    r = random.Random(seed)
    base = random_tree(r, 40)
    put(place / "o", base)
    copies = {"same": dict(base), "content": edited(r, base, False), "trees": edited(r, base, True)}
    for name, files in copies.items():
        put(place / name, files)
    got = run(spark, place, list(copies))
    worst = []
    for i, files in enumerate(copies.values()):
        trees, contents = oracle(base, files)
        d = f"destination-{i + 1}"
        assert real(got.counts[d]) == count(trees or contents)
        worst.append(4 if trees else 1 if contents else 0)
        assert got.statuses[d] == worst[-1]
        assert os.path.isfile(os.path.join(got.results, f"hashes-{d}.txt")) == (not trees)
        if not trees:
            diff = lines.read_list(spark, os.path.join(got.results, f"diff-{d}.txt"), "diff", {"mode": "full"})
            assert sorted((bytes(x["path"]), x["status"]) for x in diff.collect()) == sorted(contents.items())
            listed = open(os.path.join(got.results, f"transfer-{d}.lst"), "rb").read()
            assert listed == b"".join(p + b"\0" for p in sorted(contents))
        else:
            diff = lines.read_list(spark, os.path.join(got.results, f"tree-diff-{d}.txt"), "tree-diff")
            assert sorted((bytes(x["path"]), x["status"], x["section"]) for x in diff.collect()) == sorted((p, s, 2 if s == "EXTRA" else 1) for p, s in trees.items())
    assert got.exit_code == max(worst)
    hashes = lines.read_list(spark, os.path.join(got.results, "hashes-origin.txt"), "hashes", {"mode": "full", "root": str(place / "o")})
    md5 = lambda v: hashlib.md5(v[1] if isinstance(v, tuple) else v).hexdigest()
    assert [(bytes(x["path"]), x["hash"]) for x in hashes.orderBy("pos").collect()] == [(p, md5(base[p])) for p in sorted(base)]
    entries = lines.read_list(spark, os.path.join(got.results, "tree-origin.txt"), "tree")
    assert [bytes(x["path"]) for x in entries.orderBy("pos").collect()] == sorted(base)


def test_lists_are_checked(spark, place):
    put(place / "o", {b"a": b"1", b"b": b"2"})
    put(place / "d", {b"a": b"1", b"b": b"2"})
    results = run(spark, place, ["d"]).results
    path = os.path.join(results, "hashes-origin.txt")
    good = open(path, "rb").read()
    assert good.startswith(b"# treeparity hashes: 1\n# root: ") and b"\n# finished: " in good
    record = [x for x in good.split(b"\n") if x.startswith(b"F ")]
    for bad in (good.replace(b": 1\n", b": 2\n", 1), good.replace(b"\n".join(record), b"\n".join(record[::-1])), good.replace(b"F ", b"G ", 1), good[:-1], good.replace(b"mode: full", b"mode: fast"), b"\n", good.replace(record[1], record[0])):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(lines.BadList):
            lines.read_list(spark, path, "hashes", {"mode": "full"})
    with pytest.raises(lines.BadList):
        lines.read_list(spark, os.path.join(results, "tree-origin.txt"), "tree", {"root": "/elsewhere"})


def forget(store):
    past = store.load()
    past.finished = False
    store.save(past)
    return past


def damaged(spark, store, damage, chunks, rows, sizes):
    """Chunks that a record may name after some harm, and how many rows of them hold."""
    folder = lambda c: store.path("digests", "destination", c)
    broken = f"x-{damage.replace(' ', '-')}"
    if damage == "cut":
        return chunks[:2], sum(sizes[:2])
    if damage == "hole":
        return [chunks[0], *chunks[2:]], sizes[0]
    if damage == "foreign":
        rows[1].withColumn("path", F.encode(F.lit("zzz"), "utf-8")).write.parquet(folder(broken))
        return [chunks[0], broken, *chunks[2:]], sizes[0]
    if damage == "doubled":
        return [*chunks, chunks[1]], sizes[0]
    if damage == "bad hash":
        rows[2].withColumn("hash", F.lit("short")).write.parquet(folder(broken))
        return [*chunks[:2], broken], sum(sizes[:2])
    if damage == "changed last":
        last = rows[1].agg(F.max("pos")).first()[0]
        rows[1].withColumn("hash", F.when(F.col("pos") == last, "0" * 32).otherwise(F.col("hash"))).write.parquet(folder(broken))
        return [chunks[0], broken], sum(sizes[:2]) - 1
    return (["gone"], 0) if damage == "lost" else (chunks, 30)


def test_resumed_runs_equal_whole_ones(spark, place):
    r = random.Random(5)
    base = {b"f%03d" % i: r.randbytes(50 + i) for i in range(30)}
    put(place / "o", base)
    put(place / "d", edited(r, base, False))
    whole = run(spark, place, ["d"], chunk_cost=2_000_000)
    assert whole.exit_code == 1
    store = Store(str(place / "out"))
    chunks = store.load().journal["destination"]
    assert len(chunks) > 2
    rows = [spark.read.parquet(store.path("digests", "destination", c)) for c in chunks]
    sizes = [x.count() for x in rows]
    for damage in ("none", "cut", "hole", "foreign", "doubled", "bad hash", "changed last", "lost"):
        past = forget(store)
        past.journal["destination"], kept = damaged(spark, store, damage, chunks, rows, sizes)
        store.save(past)
        again = run(spark, place, ["d"], on_existing="resume", chunk_cost=r.choice([2_000_000, 3_500_000]))
        assert again.reused == {"origin": 30, "destination": kept}, damage
        assert (again.exit_code, again.counts) == (whole.exit_code, whole.counts), damage
    listed = lines.read_list(spark, os.path.join(again.results, "hashes-destination.txt"), "hashes")
    assert listed.count() == 30


def test_resume_refuses_changed_trees(spark, place):
    base = {b"f%d" % i: b"x" * i for i in range(9)}
    put(place / "o", base)
    put(place / "d", base)
    run(spark, place, ["d"])
    store = Store(str(place / "out"))
    forget(store)
    os.utime(place / "d/f3", (5, 5))
    put(place / "o", {b"new": b""})
    os.unlink(place / "o/f1")
    got = run(spark, place, ["d"], on_existing="resume")
    assert got.exit_code == 2
    found = lines.read_list(spark, store.path("tree-changes.txt"), "changes").collect()
    assert sorted((x["section"], x["status"], bytes(x["path"])) for x in found) == [(1, "ADDED", b"new"), (1, "DELETED", b"f1"), (2, "CHANGED", b"f3")]
    with pytest.raises(Refused):
        run(spark, place, ["d"], on_existing="recheck")
    with pytest.raises(Refused):
        run(spark, place, ["d"], on_existing="resume", fast=True)


def test_recheck_reads_only_what_differed(spark, place):
    r = random.Random(1)
    base = {b"n%02d" % i: r.randbytes(64) for i in range(12)}
    put(place / "o", base)
    for d, i in (("d", 3), ("e", 7)):
        put(place / d, base | {b"n%02d" % i: b"y" * 64, b"n09": b"z" * 64})
    assert run(spark, place, ["d", "e"]).exit_code == 1
    put(place / "d", {b"n03": base[b"n03"]})
    put(place / "e", {b"n07": base[b"n07"], b"n09": base[b"n09"]})
    for side in "ode":
        os.unlink(place / side / "n03")
    got = run(spark, place, ["d", "e"], on_existing="recheck")
    assert [real(got.counts[f"destination-{k}"]) for k in (1, 2)] == [{"HASH": 1}, {}]
    assert any("in no tree any more" in s for s in got.summary) and lines.read_list(spark, os.path.join(got.results, "hashes-origin.txt"), "hashes").count() == 2
    put(place / "d", {b"n09": base[b"n09"]})
    assert run(spark, place, ["d", "e"], on_existing="recheck").exit_code == 0


@pytest.mark.parametrize("when", ["scan", "digest"])
def test_a_failing_destination_stands_alone(spark, place, monkeypatch, when):
    put(place / "o", {b"a": b"1", b"b": b"2"})
    for d, v in (("d", b"2"), ("gone", b"2"), ("e", b"3")):
        put(place / d, {b"a": b"1", b"b": v})
    own = engine._Engine.scan if when == "scan" else engine._Engine.digest

    def fails(self, *args):
        side = args[0] if when == "scan" else args[1]
        if side == "destination-2":
            if when == "digest":
                raise OSError(5, "device lost")
            shutil.rmtree(place / "gone")
        return own(self, *args)

    monkeypatch.setattr(engine._Engine, when, fails)
    got = run(spark, place, ["d", "gone", "e"])
    assert got.statuses == {"destination-1": 0, "destination-2": 2, "destination-3": 1} and got.exit_code == 2
    assert set(got.failures) == {"destination-2"} and any(s.startswith("destination-2: failed") for s in got.summary)


def test_a_failing_origin_has_no_verdict(spark, place, monkeypatch, capsys):
    put(place / "o", {b"a": b"1"})
    put(place / "d", {b"a": b"1"})
    own = engine._Engine.digest

    def fails(self, entries, side):
        return own(self, entries, side).where("raise_error('lost') is null")

    monkeypatch.setattr(engine._Engine, "digest", fails)
    assert cli.main([str(place / "o"), str(place / "d"), "-o", str(place / "out"), "-j", "1"], spark) == 2
    assert "failed" in capsys.readouterr().err
    monkeypatch.setattr(engine._Engine, "digest", own)
    assert cli.main([str(place / "o"), str(place / "d"), "-o", str(place / "out"), "-j", "1", "--force"], spark) == 0
    assert "chunk 1 of 1" in capsys.readouterr().err


def test_sampled_files(spark, place):
    r = random.Random(3)
    raw, fast = bytearray(r.randbytes(900_001)), dict(fast=True, gap=400_000, block=1024)
    at = content.plan(len(raw), 400_000, 1024, 200_000)
    put(place / "o", {b"image": bytes(raw)})
    raw[at[2] + 2000] ^= 4  # between two blocks
    put(place / "d", {b"image": bytes(raw)})
    assert run(spark, place, ["d"], **fast).exit_code == 0
    raw[at[-1] + 1023] ^= 4
    put(place / "d", {b"image": bytes(raw)})
    got = run(spark, place, ["d"], on_existing="force", **fast)
    assert got.exit_code == 1 and any(s.startswith(f"by sample: 2 file(s), {2 * len(at)} blocks") for s in got.summary)


def test_single_files_and_other_kinds(spark, place):
    put(place, {b"one": b"\0" * 700, b"two": b"\0" * 699 + b"\1"})
    got = run_comparison(spark, place / "one", [place / "two"], str(place / "out"), file_mode=True)
    assert got.exit_code == 1 and got.commands["destination"].endswith("two'") and real(got.counts["destination"]) == {"HASH": 1}
    put(place / "o", {b"f": b"", b"sub/g": b""})
    put(place / "d", {b"f": b"", b"sub/g": b""})
    os.mkfifo(place / "d/queue")
    os.makedirs(place / "o/empty/deep")
    got = run(spark, place, ["d"], on_existing="force")
    assert got.exit_code == 0 and any(s.startswith("destination: 2 entries, 1 of other kinds") for s in got.summary)


def test_one_root_inside_another(spark, place):
    put(place / "o", {b"a": b"1", b"in [1]/a": b"1"})
    got = run(spark, place, ["o/in [1]"])
    assert got.exit_code == 0
    put(place / "o", {b"b": b"1"})
    got = run(spark, place, ["o/in [1]"], on_existing="force")
    assert got.exit_code == 4 and "--exclude='/in \\[1]/'" in got.commands["destination"]


def test_refusals_and_the_lock(spark, place):
    put(place / "o", {b"a": b"1"})
    put(place / "d", {b"a": b"1"})
    for dests in (["o"], ["nowhere"], ["d"] * 65, []):
        with pytest.raises(Refused):
            run(spark, place, dests)
    code = f"import sys, time; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})\nfrom treeparity.plans.store import Store\ns = Store({str(place / 'out')!r}); s.lock(); print('held', flush=True); time.sleep(60)"
    holder = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE)
    try:
        assert holder.stdout.readline() == b"held\n"
        with pytest.raises(Locked, match=f"process {holder.pid}"):
            run(spark, place, ["d"])
        assert run(spark, place, ["d"], ignore_lock=True).exit_code == 0
    finally:
        holder.kill()
        holder.wait()


def test_command_line(spark, place, capsys, monkeypatch):
    put(place / "o", {b"a": b"1"})
    put(place / "d", {b"a": b"2"})
    args = [str(place / "o"), str(place / "d"), "-o", str(place / "out"), "-j", "2"]
    assert cli.main(args, spark) == 1
    assert "content differs, 1 HASH" in capsys.readouterr().out
    assert cli.main(args, spark) == 2  # results are in the way and nobody can be asked
    monkeypatch.setattr(sys.stdin, "isatty", lambda: True, raising=False)
    monkeypatch.setattr("builtins.input", lambda _: "c")
    assert cli.main([*args, "-q"], spark) == 1
    monkeypatch.setattr("builtins.input", lambda _: "")
    assert cli.main([*args, "-q"], spark) == 2
    monkeypatch.setattr(engine._Engine, "_run", lambda self: (_ for _ in ()).throw(KeyboardInterrupt()))
    assert cli.main([*args, "--force"], spark) == 128 + signal.SIGINT
    monkeypatch.setattr(engine._Engine, "_run", lambda self: (os.kill(os.getpid(), signal.SIGTERM), time.sleep(5)))
    with pytest.raises(SystemExit) as e:
        cli.main([*args, "--force"], spark)
    assert e.value.code == 128 + signal.SIGTERM
    for bad in ("1x", "1KB", "+1", "", "9223372036854775808"):
        with pytest.raises(SystemExit):
            cli.main(["o", "d", "-f", f"--gap={bad}"], spark)


@pytest.mark.parametrize("tasks", [1, 4, 50])
def test_deep_trees_are_scanned_whole(spark, place, tasks):
    r = random.Random(tasks)
    files = {b"/".join(b"%d" % r.randrange(2) for _ in range(r.randrange(1, 9))) + b"/leaf%d" % i: b"" for i in range(60)}
    put(place / "o", files)
    got = tree.scan(spark, place / "o", tasks=tasks).where(F.col("type") == "F").collect()
    assert sorted(bytes(x["path"]) for x in got) == sorted(files)
