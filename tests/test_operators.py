from conftest import rows_of
from pyspark.sql import functions as F

from treeparity.operators import compare, ordered, recheck, report

E = "path string, type string, size bigint, mtime bigint, errno int, hash string"


def entries(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], E)


def test_every_status_first_match_wins(spark):
    o = entries(spark, ("same", "F", 1, 0, None, "a"), ("miss", "F", 1), ("hash", "F", 1, 0, None, "a"), ("size", "F", 1, 0, None, "a"), ("type", "L", 1, 0, None, "a"), ("edst", "F", 1), ("esrc", "E", None, None, 13), ("esrc2", "E", None, None, 2), ("both", "E", None, None, 5), ("sampled", "S", 1, 0, None, "a"))
    d = entries(spark, ("same", "F", 1, 9, None, "a"), ("hash", "F", 1, 0, None, "b"), ("size", "F", 2, 0, None, "b"), ("type", "F", 2, 0, None, "b"), ("edst", "E", None, None, 13), ("esrc", "F", 1), ("both", "E", None, None, 5), ("extra", "F", 1, 0, None, "c"), ("extra2", "E", None, None, 13), ("sampled", "F", 1, 0, None, "a"))
    assert rows_of(compare.compare_content(o, d)) == sorted(
        [("miss", "MISSING", None, "-"), ("hash", "HASH", "a", "b"), ("size", "SIZE", "a", "b"), ("type", "TYPE", "a", "b"), ("edst", "ERR-DST", None, "13"), ("esrc", "ERR-SRC", "13", None), ("esrc2", "ERR-SRC", "2", "-"), ("both", "ERR-SRC", "5", "5"), ("extra", "EXTRA", "-", "c"), ("extra2", "EXTRA", "-", "13")],
        key=repr,
    )
    trees = {r["path"]: (r["section"], r["status"]) for r in compare.compare_trees(o, d).collect()}
    assert "hash" not in trees and trees["extra2"] == ("destination", "EXTRA") and trees["edst"] == ("destination", "ERR-DST") and trees["esrc"] == ("origin", "ERR-SRC")
    assert {r["path"] for r in compare.to_transfer(compare.compare_content(o, d)).collect()} == {"miss", "hash", "size", "type", "edst"}


def test_empty_sides(spark):
    o, none = entries(spark, ("a", "F", 1)), entries(spark).where("false")
    assert [r["status"] for r in compare.compare_trees(o, none).collect()] == ["MISSING"]
    assert [r["status"] for r in compare.compare_trees(none, o).collect()] == ["EXTRA"]
    assert compare.compare_trees(none, none).isEmpty()


def test_star_with_an_empty_destination(spark):
    o = entries(spark, ("a", "F", 1, 0, None, "x"))
    dests = o.withColumn("dest", F.lit("d1"))
    names = spark.createDataFrame([("d1",), ("d2",)], "dest string")
    diff = compare.compare_star(o, dests, names)
    assert rows_of(diff.select("dest", "status")) == [("d2", "MISSING")]
    counts = {r["dest"]: r["MISSING"] for r in report.status_counts(diff, names).collect()}
    assert counts == {"d1": 0, "d2": 1}


def test_changes_look_at_times(spark):
    a = entries(spark, ("t", "F", 1, 5), ("s", "F", 1, 5), ("gone", "F", 1, 5), ("e", "E", None, None, 13), ("same", "L", 2, 3))
    b = entries(spark, ("t", "F", 1, 6), ("s", "F", 2, 5), ("new", "F", 1, 5), ("e", "E", None, None, 2), ("same", "L", 2, 3))
    assert rows_of(compare.tree_changes(a, b)) == [("e", "CHANGED"), ("gone", "DELETED"), ("new", "ADDED"), ("s", "CHANGED"), ("t", "CHANGED")]


def test_positions_are_in_byte_order(spark):
    paths = [b"a", b"a-b", b"a/x", b"B", b"a\xff", b"a\x7f", "é".encode(), b"a/deep/er"]
    df = spark.createDataFrame([(bytearray(p), s) for p in paths for s in ("x", "y")], "path binary, side string")
    got = ordered.with_position(spark, df, by=["side"])
    for s in ("x", "y"):
        assert [bytes(r["path"]) for r in got.where(F.col("side") == s).orderBy("pos").collect()] == sorted(paths)
        assert sorted(r["pos"] for r in got.where(F.col("side") == s).collect()) == list(range(len(paths)))


def test_order_and_prefixes(spark):
    lines = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b"), (3, "b"), (4, "z")], "pos bigint, path string")
    assert rows_of(ordered.order_violations(lines).select("pos")) == [(2,), (3,)]
    assert rows_of(ordered.prefix(lines, "path <> 'b'").select("pos")) == [(0,), (1,)]
    assert ordered.prefix(lines, "true").count() == 5
    assert ordered.prefix(lines, "false").count() == 0


def test_resume_prefix_stops_at_the_first_mismatch(spark):
    now = spark.createDataFrame([(0, "a", "F"), (1, "b", "L"), (2, "c", "F"), (3, "d", "F")], "pos bigint, path string, type string")
    schema = "pos bigint, path string, type string, valid boolean"
    keep = lambda *rows: sorted(r["pos"] for r in ordered.resume_prefix(spark.createDataFrame(list(rows), schema), now).collect())
    good = [(0, "a", "S", True), (1, "b", "L", True), (2, "c", "E", True), (3, "d", "F", True)]
    assert keep(*good) == [0, 1, 2, 3]
    assert keep(good[0], (1, "b", "F", True), *good[2:]) == [0]
    assert keep(good[0], good[1], (2, "x", "F", True), good[3]) == [0, 1]
    assert keep((0, "a", "F", False), *good[1:]) == []
    kept = ordered.resume_prefix(spark.createDataFrame(good[:3], schema), now)
    assert rows_of(ordered.to_read(now, kept).select("path")) == [("c",), ("d",)]


def test_recheck(spark):
    diff = spark.createDataFrame([("d1", "EXTRA", "x"), ("d1", "HASH", "a"), ("d2", "MISSING", "b"), ("d2", "HASH", "a")], "dest string, status string, path string")
    sets = recheck.recheck_sets(diff)
    assert rows_of(recheck.recheck_union(sets)) == [("a",), ("b",)]
    assert rows_of(recheck.gone(sets, spark.createDataFrame([("a",)], "path string"))) == [("b",)]
    pairs = spark.createDataFrame([("d1", "b"), ("d2", "b")], "dest string, path string")
    assert rows_of(recheck.only_own(pairs, sets)) == [("d2", "b")]


def test_run_status_is_the_most_severe(spark):
    schema = "dest string, failed boolean, tree_differs boolean, errors bigint, differences bigint"
    facts = [("a", False, False, 0, 0), ("b", False, False, 0, 3), ("c", False, False, 1, 3), ("d", False, True, 9, 3), ("e", True, True, 0, 0)]
    for n, want in zip(range(1, 6), [0, 1, 3, 4, 2], strict=True):
        each = report.exit_statuses(spark.createDataFrame(facts[:n], schema))
        assert report.run_status(each).first()[0] == want


def test_same_rows_for_any_partitioning(spark):
    o = spark.range(500).selectExpr("cast(id as string) as path", "'F' as type", "id as size", "md5(cast(id as string)) as hash")
    d = o.selectExpr("path", "type", "if(size % 7 = 0, size + 1, size) as size", "if(size % 11 = 0, 'x', hash) as hash").where("size % 13 <> 0")
    once = rows_of(compare.compare_content(o.coalesce(1), d.coalesce(1)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows_of(compare.compare_content(o.repartition(8), d.repartition(7, "size"))) == once
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
