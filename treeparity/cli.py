"""Command line: ``python -m treeparity.cli ORIGIN DEST...``."""

from __future__ import annotations

import argparse
import re
import signal
import sys
import threading

from . import __version__

_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def parse_size(s: str) -> int:
    """Digits and at most one of K, M, G, T; below 2**63."""
    m = re.fullmatch(r"([0-9]+)([kmgtKMGT]?)", s)
    if not m or (n := int(m[1]) * _UNITS[m[2].lower()]) >= 1 << 63:
        raise argparse.ArgumentTypeError(f"not a size: '{s}'")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treeparity", description="Compare the content of one tree with that of others and list what to copy again.")
    p.add_argument("origin")
    p.add_argument("destinations", nargs="+")
    p.add_argument("-o", "--output", default=".", help="directory for the results, which must exist")
    p.add_argument("--file", action="store_true", help="compare files instead of directories")
    existing = p.add_mutually_exclusive_group()
    for name in ("resume", "force", "recheck"):
        existing.add_argument(f"--{name}", dest="on_existing", action="store_const", const=name)
    p.add_argument("-f", "--fast", action="store_true", help="read large files by sample")
    p.add_argument("-g", "--gap", type=parse_size, default=64 << 20, help="longest stretch that a sample may leave unread")
    p.add_argument("-b", "--block", type=parse_size, default=0)
    p.add_argument("--profile", choices=["ssd", "hdd"], default="ssd")
    p.add_argument("-j", "--jobs", type=int, default=32, help="tasks of a side, 1 to 256")
    p.add_argument("--serial", action="store_true", help="one task after another")
    p.add_argument("-x", "--one-file-system", action="store_true")
    p.add_argument("--number-of-destinations", type=int)
    p.add_argument("--ignore-lock", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-V", "--version", action="version", version=__version__)
    return p


def _ended(number, frame):
    raise SystemExit(128 + number)


def _ask(state: str) -> str | None:
    """What to do about results of an earlier run, asked for on the terminal."""
    ways = {"f": "force"} | ({"r": "resume"} if state == "INTERRUPTED" else {"c": "recheck"} if state == "FINISHED_DIFF" else {})
    shown = ", ".join(f"{k} ({v})" for k, v in ways.items())
    return ways.get(input(f"There are results of a run in state {state}: {shown}, or nothing to leave them? ").strip().lower())


def main(argv: list[str] | None = None, spark=None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.number_of_destinations not in (None, len(a.destinations)):
        p.error(f"{len(a.destinations)} destinations and not {a.number_of_destinations}")
    if not 1 <= a.jobs <= 256:
        p.error("jobs: 1 to 256")
    if not a.fast and (a.block or a.gap != 64 << 20):
        print("treeparity: gap and block have no effect without --fast", file=sys.stderr)
    from pyspark.sql import SparkSession

    from .plans.engine import Refused, run_comparison
    from .plans.store import Locked

    spark = spark or SparkSession.builder.appName("treeparity").getOrCreate()
    progress = None if a.quiet else lambda line: print(line, file=sys.stderr, flush=True)

    def compare(on_existing):
        return run_comparison(spark, a.origin, a.destinations, a.output, a.file, a.fast, a.gap, a.block, a.profile, a.one_file_system, on_existing=on_existing, parallelism=1 if a.serial else a.jobs, ignore_lock=a.ignore_lock, progress=progress)

    if threading.current_thread() is threading.main_thread():
        signal.signal(signal.SIGTERM, _ended)
    try:
        try:
            result = compare(a.on_existing)
        except Refused as e:
            if not e.state or a.on_existing or not sys.stdin.isatty():
                raise
            result = compare(_ask(e.state))
    except KeyboardInterrupt:
        return 128 + signal.SIGINT
    except (Refused, Locked) as e:
        print(f"treeparity: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # whatever Spark, a task or the file system raised: no verdict on the content
        print(f"treeparity: failed: {e}", file=sys.stderr)
        return 2
    if not a.quiet:
        print("\n".join(result.summary))
        for dest, command in result.commands.items():
            print(f"command for {dest}:\n{command}")
    return result.exit_code


if __name__ == "__main__":
    sys.exit(main())
