import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeparity.functions import digest, sampling, text
from treeparity.operators import report
from treeparity.sources import content

MAX = sampling.MAX


def plan_oracle(n, gap, block, seek):
    """The plan's rules in unbounded integers, overflow told by size."""
    if n <= 2 * block:
        return None
    k = 2 if gap + block > MAX else -((block - n) // (gap + block)) + 1
    if k * block >= n or k * block > MAX or k * (seek + block) > MAX or seek + n > MAX or k * (seek + block) >= seek + n:
        return None
    return k


def cases():
    r = random.Random(5)
    out = [(10 << 30, 64 << 20, 1 << 20, 1_440_000), (0, 1, 512, 200_000), (1024, 1, 512, 0), (1025, 1, 512, 0), (MAX, MAX, 512, 200_000), (MAX, 1, 512, 200_000), (1 << 62, 1 << 20, 65536, 200_000)]
    for _ in range(400):
        b = r.choice([512, 4096, 65536, 1 << 20, r.randrange(512, 1 << 22)])
        out.append((r.randrange(0, 1 << r.randrange(1, 64)) & MAX, r.randrange(1, 1 << r.randrange(1, 63)), b, r.choice([0, 256, 200_000, 1_440_000])))
    return out


def test_plan_equals_oracle(spark):
    df = spark.createDataFrame(cases(), "n bigint, gap bigint, block bigint, seek bigint")
    for r in df.withColumn("k", sampling.n_samples(F.col("n"), F.col("gap"), F.col("block"), F.col("seek"))).collect():
        assert r["k"] == plan_oracle(r["n"], r["gap"], r["block"], r["seek"]), r


def test_known_plan(spark):
    k = spark.range(1).select(sampling.n_samples(F.lit(10 << 30), 64 << 20, *sampling.PROFILES["hdd"])).first()[0]
    assert k == 159


def test_offsets_and_spans(spark):
    small = [(n, g, b, s) for n, g, b, s in cases() if (k := plan_oracle(n, g, b, s)) and k < 2000]
    df = spark.createDataFrame(small, "n bigint, gap bigint, block bigint, seek bigint")
    df = df.withColumn("k", sampling.n_samples(F.col("n"), F.col("gap"), F.col("block"), F.col("seek"))).withColumn("at", sampling.offsets(F.col("n"), F.col("block"), F.col("k")))
    df = df.withColumn("s", sampling.spans(F.col("at"), F.col("block"), 65536))
    assert len(small) > 20
    for r in df.collect():
        at = content.plan(r["n"], r["gap"], r["block"], r["seek"])
        assert r["at"] == at and at[0] == 0 and at[-1] == r["n"] - r["block"]
        gaps = [y - x - r["block"] for x, y in zip(at, at[1:], strict=False)]
        assert max(gaps) <= r["gap"]
        assert r["s"]["bytes_read"] == r["k"] * r["block"] + sum(g for g in gaps if g < 65536)
        assert r["s"]["n_spans"] == 1 + sum(g >= 65536 for g in gaps)


def test_digests(spark):
    raw = bytes(random.Random(1).randrange(256) for _ in range(9000))
    df = spark.createDataFrame([(raw,)], "c binary").withColumn("n", F.octet_length("c").cast("bigint")).withColumn("k", sampling.n_samples(F.col("n"), 1024, 512, 256)).withColumn("at", sampling.offsets(F.col("n"), 512, F.col("k")))
    r = df.select("at", digest.full_digest(F.col("c")).alias("f"), digest.sampled_digest(F.col("c"), F.col("at"), 512).alias("s")).first()
    assert r["f"] == hashlib.md5(raw).hexdigest()
    assert r["s"] == hashlib.md5((9000).to_bytes(8, "little") + b"".join(raw[o : o + 512] for o in r["at"])).hexdigest()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30).map(lambda b: b.replace(b"\0", b"x")), min_size=20, max_size=40))
def test_escape_round_trip(spark, paths):
    df = spark.createDataFrame([(bytearray(p),) for p in paths], "p binary")
    e = text.escape(text.as_chars(F.col("p")))
    for r in df.select("p", text.as_bytes(e).alias("e"), text.as_bytes(text.unescape(e)).alias("b")).collect():
        assert bytes(r["b"]) == bytes(r["p"])
        assert b"\n" not in r["e"] and b"\r" not in r["e"]


def test_unescape_refuses(spark):
    bad = ["\\", "a\\", "\\t", "a\nb", "a\rb", "\\\\\\", "a\0b"]
    good = {"\\\\n": "\\n", "a\\nb": "a\nb", "\\\\\\r": "\\\r", "": "", "plain": "plain"}
    df = spark.createDataFrame([(s,) for s in [*bad, *good]], "s string")
    got = {r[0]: r[1] for r in df.select("s", text.unescape(F.col("s"))).collect()}
    assert all(got[b] is None for b in bad)
    assert all(got[g] == v for g, v in good.items())


def test_clean_path(spark):
    want = {"/a/./b//../c/..//d/": "/a/d", "/": "/", "/..": "/", "//": "/", "x/../y": "/w/d/y", "../..": "/", "/a/b/": "/a/b", "/a/../../b": "/b"}
    df = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r[0]: r[1] for r in df.select("s", text.clean_path(F.col("s"), "/w/d")).collect()} == want


def test_parse_size(spark):
    want = {"8X": None, "8MB": None, "-1": None, "": None, "9223372036854775808": None, "8388608T": None, "8M": 8 << 20, "8m": 8 << 20, "8388607T": 8388607 << 40, "0": 0, "0007k": 7168, " 1": None, "+5": None}
    df = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r[0]: r[1] for r in df.select("s", text.parse_size(F.col("s"))).collect()} == want


def test_human_bytes(spark):
    values = [0, 1, 1023, 1024, 1535, 1536, 2047, (1 << 20) - 1, 1 << 20, (1 << 30) * 7 // 2, MAX]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = {r[0]: r[1] for r in df.select("v", text.human_bytes(F.col("v"))).collect()}
    assert got == {v: report.human_bytes(v) for v in values}
    assert got[1536] == "1.5 KiB" and got[2047] == "1.9 KiB" and got[1023] == "1023 B"


def test_records(spark):
    good_hash = "0123456789abcdef" * 2
    tree = {"F 5 -7 a b": ("F", 5, -7, "a b"), "L 0 1 x\\ny": ("L", 0, 1, "x\ny"), "E 13 - p": ("E", 13, None, "p"), "S 5 7 a": None, "F 5 7 ": None, "F -5 7 a": None, "F 5 7": None, "F 5 +7 a": None, "FF 5 7 a": None, "E 13 0 p": None, "F 5 7 a\\": None}
    hashes = {f"F {good_hash} 9 a": ("F", 9, good_hash), f"S {good_hash} 9 a b": ("S", 9, good_hash), f"F {good_hash.upper()} 9 a": None, f"F {good_hash[1:]} 9 a": None, f"F {good_hash} -9 a": None, f"X {good_hash} 9 a": None, "E 2 - a": ("E", 2, None)}
    df = spark.createDataFrame([(s,) for s in tree], "s string").select("s", text.parse_record(F.col("s"), False).alias("r"))
    assert {r["s"]: r["r"] and (r["r"]["type"], r["r"]["num"], r["r"]["mtime"], r["r"]["path"]) for r in df.collect()} == tree
    df = spark.createDataFrame([(s,) for s in hashes], "s string").select("s", text.parse_record(F.col("s"), True).alias("r"))
    assert {r["s"]: r["r"] and (r["r"]["type"], r["r"]["num"], r["r"]["hash"]) for r in df.collect()} == hashes


def test_quotes_and_names(spark):
    r = spark.range(1).select(
        text.shell_quote(F.lit("it's")), text.pattern_quote(F.lit("a*b?c[d]\\")), text.archive_name(F.lit("26/11/2026 09:05")), text.archive_name(F.lit("x")),
        text.time_from_stamp(F.lit("202611260905")), text.time_from_stamp(F.lit("x")), text.header_value(F.lit("# mode: full"), "mode"), text.join_path(F.lit("/a/"), F.lit("b")), text.plural(F.lit(1)),
    ).first()
    assert tuple(r) == ("'it'\\''s'", "/a\\*b\\?c\\[d]\\\\/", "scan-202611260905", "scan-unknown", "26/11/2026 09:05", None, "full", "/a/b", "")
