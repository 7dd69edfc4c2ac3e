"""The queries over the driver tables and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import digest, sampling, text
from ..operators import compare, ordered, recheck, report
from ..scratch import Scratch
from ..sources import lines
from . import pairs
from .pairs import pair_sql, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Sampling parameters small enough for the driver's texts.
GAP, BLOCK, SEEK, MERGE = 1024, 512, 256, 1200


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return register


_HASHES = "CASE WHEN ot IS NULL THEN '-' WHEN ot = 'E' THEN CAST(oe AS VARCHAR) ELSE oh END AS origin_hash, CASE WHEN dt IS NULL THEN '-' WHEN dt = 'E' THEN CAST(de AS VARCHAR) ELSE dh END AS dest_hash"


# Comparison.


@query(f"WITH {pair_sql()} SELECT path, status, CASE WHEN status IN ('EXTRA', 'ERR-DST') THEN 'destination' ELSE 'origin' END AS section FROM j WHERE dest = 'destination-1' AND status IS NOT NULL AND status <> 'HASH'")
def tree_diff(spark, d):
    return compare.compare_trees(pairs.origin(spark, d), pairs.destination(spark, d))


@query(f"WITH {pair_sql()} SELECT path, status, {_HASHES} FROM j WHERE dest = 'destination-1' AND status IS NOT NULL")
def content_diff(spark, d):
    return compare.compare_content(pairs.origin(spark, d), pairs.destination(spark, d))


def _star(spark, d, add=0):
    return compare.compare_star(pairs.origin(spark, d), pairs.destinations(spark, d, add), pairs.names(spark))


@query(f"WITH {pair_sql()} SELECT dest, path, status, {_HASHES} FROM j WHERE status IS NOT NULL")
def multi_dest_diff(spark, d):
    return _star(spark, d)


_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS \"{s}\"" for s in schemas.CONTENT_ORDER)


@query(f"WITH {pair_sql()} SELECT n.dest, {_COUNTS} FROM names n LEFT JOIN j ON n.dest = j.dest GROUP BY n.dest")
def status_counts(spark, d):
    return report.status_counts(_star(spark, d), pairs.names(spark))


def _facts_of(counts: DataFrame) -> DataFrame:
    total = sum((F.col(f"`{s}`") for s in schemas.CONTENT_ORDER), F.lit(0))
    return counts.select("dest", (F.col("dest") == "destination-3").alias("failed"), (F.col("dest") == "destination-2").alias("tree_differs"), (F.col("`ERR-SRC`") + F.col("`ERR-DST`")).alias("errors"), total.alias("differences"))


@query(
    f"WITH {pair_sql()}, x AS (SELECT dest, CASE WHEN dest = 'destination-3' THEN 2 WHEN dest = 'destination-2' THEN 4 WHEN count(*) FILTER (WHERE status IN ('ERR-SRC', 'ERR-DST')) > 0 THEN 3 WHEN count(status) > 0 THEN 1 ELSE 0 END AS status FROM j GROUP BY dest) "
    "SELECT dest, status, (SELECT max_by(status, CASE status WHEN 2 THEN 4 WHEN 4 THEN 3 WHEN 3 THEN 2 ELSE status END) FROM x) AS run_status FROM x"
)
def exit_status(spark, d):
    each = report.exit_statuses(_facts_of(status_counts(spark, d)))
    return each.crossJoin(report.run_status(each).withColumnRenamed("status", "run_status"))


@query(f"WITH {pair_sql()} SELECT dest, path FROM j WHERE status IS NOT NULL AND status NOT IN ('EXTRA', 'ERR-SRC')")
def transfer_list(spark, d):
    return compare.to_transfer(_star(spark, d)).select("dest", "path")


@query(f"WITH {pair_sql()} SELECT n.dest, CASE WHEN count(*) FILTER (WHERE status IN ('EXTRA', 'MISSING', 'SIZE', 'TYPE')) > 0 THEN CASE WHEN count(*) FILTER (WHERE status = 'EXTRA') > 0 THEN 'rsync -a --delete-after' ELSE 'rsync -a' END END AS command FROM names n LEFT JOIN j ON n.dest = j.dest GROUP BY n.dest")
def suggest_flags(spark, d):
    return report.suggest_flags(status_counts(spark, d))


_LINES = """li AS (SELECT l_orderkey, l_linenumber, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS path, CAST(trunc(l_quantity * 1000) AS BIGINT) AS size,
  CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 86400 AS mtime FROM lineitem)"""


@query(
    f"WITH {_LINES}, a AS (SELECT * FROM li WHERE l_orderkey % 97 <> 0), b AS (SELECT path, size + CASE WHEN l_orderkey % 79 = 0 THEN 1 ELSE 0 END AS size, mtime + CASE WHEN l_orderkey % 83 = 0 THEN 1 ELSE 0 END AS mtime FROM li WHERE l_orderkey % 89 <> 0) "
    "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'ADDED' WHEN b.path IS NULL THEN 'DELETED' ELSE 'CHANGED' END AS status FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.mtime <> b.mtime"
)
def tree_changes(spark, d):
    tree = pairs.entries_of_lineitem(spark, d)
    now = tree.where("l_orderkey % 89 <> 0").withColumn("size", F.expr("size + if(l_orderkey % 79 = 0, 1, 0)")).withColumn("mtime", F.expr("mtime + if(l_orderkey % 83 = 0, 1, 0)"))
    return compare.tree_changes(tree.where("l_orderkey % 97 <> 0"), now)


@query(
    "WITH a AS (SELECT row_number() OVER (ORDER BY path) - 1 AS pos, * FROM (SELECT source || '/' || doc_id AS path, text FROM documents)), "
    "b AS (SELECT row_number() OVER (ORDER BY path) - 1 AS pos, * FROM (SELECT source || '/' || doc_id || '.copy' AS path, CASE doc_id % 50 WHEN 1 THEN '#' || substr(text, 2) WHEN 2 THEN text || 'x' ELSE text END AS text FROM documents)) "
    "SELECT a.pos, a.path, CASE WHEN octet_length(encode(a.text)) <> octet_length(encode(b.text)) THEN 'SIZE' ELSE 'HASH' END AS status, md5(a.text) AS origin_hash, md5(b.text) AS dest_hash FROM a JOIN b ON a.pos = b.pos WHERE a.text <> b.text"
)
def positional_diff(spark, d):
    docs = pairs.source(spark, d)
    slot = F.col("doc_id") % 50
    edited = F.when(slot == 1, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).when(slot == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    facts = [F.lit("F").alias("type"), F.octet_length("text").cast("bigint").alias("size"), F.lit(None).cast("int").alias("errno"), digest.full_digest(F.col("text")).alias("hash")]
    copy = docs.withColumns({"path": F.concat("path", F.lit(".copy")), "text": edited})
    a, b = (ordered.with_position(spark, x.select("path", *facts)) for x in (docs, copy))
    return compare.compare_positional(a, b)


# Sources and order.


@query("SELECT url AS path, row_number() OVER (ORDER BY url) - 1 AS pos FROM pages")
def canonical_order(spark, d):
    return ordered.with_position(spark, table(spark, d, "pages").select(F.col("url").alias("path"))).select("path", "pos")


@query(
    "SELECT l_returnflag AS side, count(*) FILTER (WHERE l_linenumber NOT IN (2, 3, 4)) AS files, count(*) FILTER (WHERE l_linenumber = 3) AS links, count(*) FILTER (WHERE l_linenumber = 4) AS ignored FROM lineitem GROUP BY 1"
)
def kind_filter(spark, d):
    mode = F.when(F.col("l_linenumber") == 2, 0o040755).when(F.col("l_linenumber") == 3, 0o120777).when(F.col("l_linenumber") == 4, 0o010644).otherwise(0o100644)
    listed = compare.kinds(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("side"), mode.alias("mode")))
    return listed.groupBy("side").agg(F.count_if(F.col("type") == "F").alias("files"), F.count_if(F.col("type") == "L").alias("links"), F.count_if("ignored").alias("ignored"))


_EVENTS = "e AS (SELECT event_id, event_type AS side, lpad(CAST(event_id AS VARCHAR), 12, '0') AS path FROM events)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("side"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"))


@query(f"WITH {_EVENTS}, l AS (SELECT event_id AS pos, CASE WHEN event_id % 97 = 0 THEN '0' ELSE path END AS path FROM e) SELECT b.pos, b.path, a.path AS before FROM l b JOIN l a ON a.pos = b.pos - 1 WHERE b.path <= a.path")
def order_check(spark, d):
    lines = _events(spark, d).select(F.col("event_id").alias("pos"), F.expr("if(event_id % 97 = 0, '0', path)").alias("path"))
    return ordered.order_violations(lines)


_JOURNAL = (
    f"{_EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY path) - 1 AS pos, CASE WHEN event_id % 11 = 0 THEN 'L' ELSE 'F' END AS type FROM e), "
    "j AS (SELECT side, pos, path, CASE WHEN event_id % 661 = 600 THEN 'F' WHEN type = 'F' AND event_id % 5 = 0 THEN 'S' ELSE type END AS type, event_id % 331 <> 330 AS valid, type AS et, CASE WHEN event_id % 997 = 900 THEN path || 'x' ELSE path END AS jpath FROM n WHERE pos % 1009 <> 1008), "
    "w AS (SELECT side, min(pos) AS stop FROM j WHERE NOT valid OR jpath <> path OR NOT ((et = 'F' AND type IN ('F', 'S')) OR (et = 'L' AND type = 'L')) GROUP BY side), "
    "k AS (SELECT j.* FROM j LEFT JOIN w ON j.side = w.side WHERE stop IS NULL OR pos < stop)"
)


def _journal(spark, d):
    now = ordered.with_position(spark, _events(spark, d), by=["side"]).withColumn("type", F.expr("if(event_id % 11 = 0, 'L', 'F')"))
    kind = F.expr("case when event_id % 661 = 600 then 'F' when type = 'F' and event_id % 5 = 0 then 'S' else type end")
    journal = now.where("pos % 1009 <> 1008").select("side", "pos", F.expr("if(event_id % 997 = 900, concat(path, 'x'), path)").alias("path"), kind.alias("type"), F.expr("event_id % 331 <> 330").alias("valid"))
    return now.select("side", "pos", "path", "type"), journal


@query(f"WITH {_JOURNAL} SELECT side, pos, path, type FROM k")
def resume_prefix(spark, d):
    now, journal = _journal(spark, d)
    return ordered.resume_prefix(journal, now, by=["side"]).select("side", "pos", "path", "type")


@query(
    f"WITH {_JOURNAL}, m AS (SELECT side, max(pos) AS last FROM k GROUP BY side), r AS (SELECT n.side, n.path, k.pos IS NOT NULL AS kept, k.pos = m.last AS verify FROM n LEFT JOIN k ON n.side = k.side AND n.pos = k.pos LEFT JOIN m ON n.side = m.side) "
    "SELECT side, count(*) FILTER (WHERE kept AND NOT verify) AS reused, max(path) FILTER (WHERE kept AND verify) AS verified, count(*) FILTER (WHERE NOT kept OR verify) AS to_read FROM r GROUP BY side"
)
def resume_reuse(spark, d):
    now, journal = _journal(spark, d)
    kept = ordered.resume_prefix(journal, now, by=["side"])
    read = ordered.to_read(now, kept, by=["side"]).groupBy("side").agg(F.count("*").alias("to_read"))
    split = ordered.split_last(kept, by=["side"]).groupBy("side").agg(F.count_if(~F.col("verify")).alias("reused"), F.max(F.when(F.col("verify"), F.col("path"))).alias("verified"))
    out = now.select("side").distinct().join(read, "side", "left").join(split, "side", "left")
    return out.na.fill(0, ["reused", "to_read"]).select("side", "reused", "verified", "to_read")


@query(f"WITH {_EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY path) - 1 AS pos FROM e), w AS (SELECT side, min(pos) AS stop FROM n WHERE event_id % 211 = 210 GROUP BY side) SELECT n.side, pos, path FROM n LEFT JOIN w ON n.side = w.side WHERE stop IS NULL OR pos < stop")
def completed_prefix(spark, d):
    now = ordered.with_position(spark, _events(spark, d), by=["side"])
    return ordered.prefix(now, "event_id % 211 <> 210", by=["side"]).select("side", "pos", "path")


# Sampling and digests.

_PLAN = """p AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1048576 ELSE 65536 END AS block, CASE WHEN l_returnflag = 'R' THEN 1440000 ELSE 200000 END AS seek,
  CASE WHEN l_suppkey % 10 = 0 THEN 9223372036854775807 ELSE CAST(power(4, l_linenumber + 4) AS BIGINT) END AS gap,
  CAST(round(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_orderkey % 5 = 0 THEN 100000000 ELSE l_orderkey % 1000 + 1 END AS n FROM lineitem),
q AS (SELECT *, CASE WHEN CAST(gap AS HUGEINT) + block > 9223372036854775807 THEN 2 ELSE (n - block) // (CAST(gap AS HUGEINT) + block) + CASE WHEN (n - block) % (CAST(gap AS HUGEINT) + block) <> 0 THEN 1 ELSE 0 END + 1 END AS k0 FROM p),
r AS (SELECT *, CAST(CASE WHEN n > 2 * block AND CAST(k0 AS HUGEINT) * block < n AND CAST(k0 AS HUGEINT) * (seek + block) < CAST(seek AS HUGEINT) + n THEN k0 END AS BIGINT) AS k FROM q)"""
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _plans(spark, d):
    p = table(spark, d, "lineitem").withColumns({"profile": F.expr("if(l_returnflag = 'R', 'hdd', 'ssd')"), "n": F.expr("cast(round(l_extendedprice * 100) as bigint) * if(l_orderkey % 5 = 0, 100000000, l_orderkey % 1000 + 1)")})
    p = p.withColumn("gap", F.expr("if(l_suppkey % 10 = 0, 9223372036854775807, cast(power(4, l_linenumber + 4) as bigint))")).withColumn("x", sampling.profile_defaults(F.col("profile")))
    return p.withColumn("k", sampling.n_samples(F.col("n"), F.col("gap"), F.col("x.block"), F.col("x.seek")))


@query(f"WITH {_PLAN} SELECT {_KEYS}, n, gap, coalesce(k, -1) AS k FROM r")
def sampling_plan(spark, d):
    return _plans(spark, d).selectExpr(*_KEYS.split(", "), "n", "gap", "coalesce(k, -1) as k")


@query(f"WITH {_PLAN} SELECT {_KEYS}, CASE WHEN k IS NULL THEN n ELSE k * block END AS read_bytes FROM r")
def plan_cost(spark, d):
    return _plans(spark, d).select(*_KEYS.split(", "), sampling.read_bytes(F.col("n"), F.col("x.block"), F.col("k")).alias("read_bytes"))


@query(f"WITH {_PLAN} SELECT {_KEYS}, CASE WHEN l_orderkey % 13 = 0 THEN 0 WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN seek ELSE CASE WHEN k IS NULL THEN n ELSE k * block END + seek END AS cost FROM r")
def entry_cost(spark, d):
    kind = F.expr("if(l_linestatus = 'O' and l_linenumber = 1, 'L', 'F')")
    cost = sampling.entry_cost(kind, F.col("n"), F.col("x.block"), F.col("x.seek"), F.col("k"), F.expr("l_orderkey % 13 = 0"))
    return _plans(spark, d).select(*_KEYS.split(", "), cost.alias("cost"))


@query("SELECT DISTINCT o_orderpriority AS name, CASE WHEN o_orderpriority LIKE '1%' THEN 65536 WHEN o_orderpriority LIKE '2%' THEN 1048576 ELSE -1 END AS block, CASE WHEN o_orderpriority LIKE '1%' THEN 200000 WHEN o_orderpriority LIKE '2%' THEN 1440000 ELSE -1 END AS seek FROM orders")
def profile_defaults(spark, d):
    p = sampling.profile_defaults(F.expr("case when o_orderpriority like '1%' then 'ssd' when o_orderpriority like '2%' then 'hdd' else 'tape' end"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("name")).distinct().withColumn("o_orderpriority", F.col("name")).select("name", *[F.coalesce(p[c], F.lit(-1)).alias(c) for c in ("block", "seek")])


_DOCS = f"""x AS (SELECT doc_id, source, text, octet_length(encode(text)) AS n FROM documents),
y AS (SELECT *, (n - {BLOCK}) // {GAP + BLOCK} + CASE WHEN (n - {BLOCK}) % {GAP + BLOCK} <> 0 THEN 1 ELSE 0 END + 1 AS k0 FROM x),
z AS (SELECT *, CASE WHEN n > {2 * BLOCK} AND k0 * {BLOCK} < n AND k0 * {SEEK + BLOCK} < {SEEK} + n THEN k0 END AS k FROM y),
i AS (SELECT doc_id, n, k, unnest(range(0, k)) AS i FROM z WHERE k IS NOT NULL), f AS (SELECT doc_id, i, i * (n - {BLOCK}) // (k - 1) AS o FROM i)"""


def _sampled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text", F.octet_length("text").cast("bigint").alias("n"))
    docs = docs.withColumn("k", sampling.n_samples(F.col("n"), GAP, BLOCK, SEEK))
    return docs.withColumn("at", sampling.offsets(F.col("n"), BLOCK, F.col("k")))


@query(f"WITH {_DOCS} SELECT doc_id, i, o AS start FROM f")
def sample_offsets(spark, d):
    return _sampled(spark, d).select("doc_id", F.posexplode("at").alias("i", "start")).withColumn("i", F.col("i").cast("bigint"))


@query(f"WITH {_DOCS}, g AS (SELECT doc_id, o - lag(o) OVER (PARTITION BY doc_id ORDER BY i) - {BLOCK} AS gap FROM f) SELECT doc_id, 1 + count(*) FILTER (WHERE gap >= {MERGE - 400}) AS n_spans, CAST(count(*) * {BLOCK} + coalesce(sum(gap) FILTER (WHERE gap < {MERGE - 400}), 0) AS BIGINT) AS bytes_read FROM g GROUP BY doc_id")
def read_spans(spark, d):
    s = sampling.spans(F.col("at"), BLOCK, MERGE - 400)
    return _sampled(spark, d).where("k is not null").select("doc_id", s["n_spans"].alias("n_spans"), s["bytes_read"].alias("bytes_read"))


@query("SELECT doc_id, md5(text) AS hash, octet_length(encode(text)) AS size FROM documents")
def full_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", digest.full_digest(F.col("text")).alias("hash"), F.octet_length("text").cast("bigint").alias("size"))


@query("SELECT page_id, md5(url) AS hash, octet_length(encode(url)) AS size FROM pages")
def link_digest(spark, d):
    return table(spark, d, "pages").select("page_id", digest.link_digest(F.col("url")).alias("hash"), F.octet_length("url").cast("bigint").alias("size"))


_LE64 = " || ".join(f"substr(printf('%016x', n), {15 - 2 * b}, 2)" for b in range(8))
_SAMPLED = f"h AS (SELECT f.doc_id, string_agg(substr(hex(encode(text)), CAST(2 * o + 1 AS BIGINT), {2 * BLOCK}), '' ORDER BY i) AS b FROM f JOIN x ON f.doc_id = x.doc_id GROUP BY f.doc_id)"


@query(f"WITH {_DOCS}, {_SAMPLED} SELECT z.doc_id, CASE WHEN k IS NULL THEN 'F' ELSE 'S' END AS type, CASE WHEN k IS NULL THEN md5(text) ELSE md5(unhex({_LE64} || b)) END AS hash FROM z LEFT JOIN h ON z.doc_id = h.doc_id")
def sampled_digest(spark, d):
    x = digest.content_digest(F.col("text"), F.col("at"), BLOCK)
    return _sampled(spark, d).select("doc_id", x["type"].alias("type"), x["hash"].alias("hash"))


_DIGESTS = f"""{_DOCS}, m AS (SELECT doc_id, CAST(count(*) * {BLOCK} + coalesce(sum(gap) FILTER (WHERE gap < {MERGE}), 0) AS BIGINT) AS b FROM (SELECT doc_id, o - lag(o) OVER (PARTITION BY doc_id ORDER BY i) - {BLOCK} AS gap FROM f) GROUP BY doc_id),
t AS (SELECT z.source AS side, n AS size, k, CASE WHEN z.doc_id % 50 = 4 THEN 'E' WHEN z.doc_id % 50 = 3 THEN 'L' WHEN k IS NULL THEN 'F' ELSE 'S' END AS type, CASE WHEN z.doc_id % 50 IN (3, 4) THEN 0 WHEN k IS NULL THEN n ELSE b END AS bytes_read FROM z LEFT JOIN m ON z.doc_id = m.doc_id)"""


def _digests(spark, d):
    kind = F.expr("case when doc_id % 50 = 4 then 'E' when doc_id % 50 = 3 then 'L' when k is null then 'F' else 'S' end")
    read = F.when(F.col("type").isin("E", "L"), F.lit(0)).otherwise(F.coalesce(sampling.spans(F.col("at"), BLOCK, MERGE)["bytes_read"], F.col("n")))
    return _sampled(spark, d).withColumn("type", kind).select(F.col("source").alias("side"), "type", F.col("n").alias("size"), F.col("k").alias("samples"), read.cast("bigint").alias("bytes_read"))


@query(f"WITH {_DIGESTS} SELECT side, count(*) AS entries, count(*) FILTER (WHERE type = 'F') AS \"full\", count(*) FILTER (WHERE type = 'S') AS sampled, count(*) FILTER (WHERE type = 'L') AS links, count(*) FILTER (WHERE type = 'E') AS errors FROM t GROUP BY side")
def side_stats(spark, d):
    return report.side_stats(_digests(spark, d))


@query(
    f"WITH {_DIGESTS}, u AS (SELECT side, count(*) FILTER (WHERE type = 'S') AS files, CAST(coalesce(sum(k) FILTER (WHERE type = 'S'), 0) AS BIGINT) AS samples, CAST(coalesce(sum(k * {BLOCK}) FILTER (WHERE type = 'S'), 0) AS BIGINT) AS sample_bytes, CAST(coalesce(sum(size) FILTER (WHERE type = 'S'), 0) AS BIGINT) AS total FROM t GROUP BY side) "
    "SELECT *, CASE WHEN total >= 10000 THEN sample_bytes // (total // 10000) WHEN total > 0 THEN sample_bytes * 10000 // total END AS coverage FROM u"
)
def sample_metrics(spark, d):
    return report.sample_metrics(_digests(spark, d), BLOCK)


@query(f"WITH {_DIGESTS} SELECT CAST(sum(bytes_read) AS BIGINT) AS bytes_read, CAST(sum(bytes_read) // 300000 AS BIGINT) AS tenths_mb_s FROM t")
def throughput(spark, d):
    return report.throughput(_digests(spark, d), 3)


# Checking again.

_SETS = "sets AS (SELECT DISTINCT dest, path FROM j WHERE status IS NOT NULL AND status <> 'EXTRA')"


def _sets(spark, d):
    """The sets of the first comparison, written once and read by each use."""
    return Scratch(spark, "sets").table(recheck.recheck_sets(_star(spark, d)), "sets")


@query(f"WITH {pair_sql()}, {_SETS} SELECT dest, path FROM sets")
def recheck_set(spark, d):
    return recheck.recheck_sets(_star(spark, d))


@query(f"WITH {pair_sql()}, {_SETS} SELECT DISTINCT path FROM sets")
def recheck_union(spark, d):
    return recheck.recheck_union(recheck.recheck_sets(_star(spark, d)))


@query(f"WITH {pair_sql()}, {_SETS} SELECT path, type, coalesce(size, -1) AS size FROM o WHERE path IN (SELECT path FROM sets)")
def recheck_filter(spark, d):
    sets = recheck.recheck_sets(_star(spark, d))
    return recheck.only(pairs.origin(spark, d), recheck.recheck_union(sets)).selectExpr("path", "type", "coalesce(size, -1) as size")


@query(f"WITH {pair_sql()}, {_SETS}, {pair_sql(1, '2')} SELECT j2.dest, j2.path, j2.status FROM j2 JOIN sets ON j2.dest = sets.dest AND j2.path = sets.path WHERE j2.status IS NOT NULL")
def recheck_compare(spark, d):
    return recheck.only_own(_star(spark, d, 1), _sets(spark, d)).select("dest", "path", "status")


@query(f"WITH {pair_sql()}, {_SETS} SELECT DISTINCT path FROM sets WHERE path NOT IN (SELECT path FROM src WHERE doc_id % 3 <> 0)")
def recheck_gone(spark, d):
    left = pairs.source(spark, d).where("doc_id % 3 <> 0")
    return recheck.gone(recheck.recheck_sets(_star(spark, d)), left)


@query("SELECT n_regionkey, CASE WHEN n_regionkey = 0 THEN 'FRESH' WHEN n_regionkey = 1 THEN 'INTERRUPTED' WHEN n_regionkey = 2 THEN 'FINISHED_CLEAN' ELSE 'FINISHED_DIFF' END AS state FROM nation GROUP BY 1")
def run_state(spark, d):
    sides = table(spark, d, "nation").selectExpr("n_regionkey", "n_regionkey > 0 as has_run", "n_regionkey > 0 and n_nationkey > 5 as has_hashes", "n_regionkey > 1 as finished", "n_regionkey > 2 as differs")
    return recheck.run_state(sides, by=["n_regionkey"])


# Text.

_ESCAPED = r"replace(replace(replace(s, '\', '\\'), chr(10), '\n'), chr(13), '\r')"


@query(rf"WITH t AS (SELECT doc_id, text || '\n' || chr(13) || '\' || chr(10) || source AS s FROM documents) SELECT doc_id, md5({_ESCAPED}) AS escaped, md5(s) AS back, doc_id % 4 = 0 AS refused FROM t")
def escape_paths(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\\n\r\\\n"), "source").alias("s")).withColumn("e", text.escape(F.col("s")))
    broken = text.unescape(F.when(F.col("doc_id") % 4 == 0, F.concat("e", F.lit("\\t"))).otherwise(F.col("e")))
    return t.select("doc_id", F.md5(F.col("e").cast("binary")).alias("escaped"), F.md5(text.unescape(F.col("e")).cast("binary")).alias("back"), broken.isNull().alias("refused"))


@query("SELECT page_id, '''' || replace(url || '''s', '''', '''\\''''') || '''' AS quoted FROM pages")
def shell_quote(spark, d):
    return table(spark, d, "pages").select("page_id", text.shell_quote(F.concat("url", F.lit("'s"))).alias("quoted"))


@query(r"SELECT page_id, '/' || regexp_replace(url || '[*]\', '([*?\[\\])', '\\\1', 'g') || '/' AS pattern FROM pages")
def pattern_quote(spark, d):
    return table(spark, d, "pages").select("page_id", text.pattern_quote(F.concat("url", F.lit("[*]\\"))).alias("pattern"))


def _lines(spark, d):
    return table(spark, d, "documents").selectExpr(
        "doc_id",
        "case doc_id % 9 when 0 then concat('F ', doc_id, ' -', n_chars, ' ', source, ' x') when 1 then concat('L ', doc_id, ' ', n_chars, ' ', source) when 2 then concat('E ', doc_id % 40, ' - ', source) "
        "when 3 then concat('F +', doc_id, ' 5 ', source) when 4 then concat('X ', doc_id, ' 5 ', source) when 5 then concat('F ', doc_id, ' 5 ') when 6 then concat('F ', doc_id, '9999999999999999999 5 ', source) "
        "when 7 then concat('E -1 - ', source) else concat('F ', doc_id, ' 5') end as line",
    )


@query("SELECT doc_id, CASE WHEN doc_id % 9 < 3 THEN ['F', 'L', 'E'][doc_id % 9 + 1] END AS type, CASE WHEN doc_id % 9 < 2 THEN doc_id WHEN doc_id % 9 = 2 THEN doc_id % 40 ELSE -1 END AS num, CASE WHEN doc_id % 9 = 0 THEN -n_chars WHEN doc_id % 9 = 1 THEN n_chars ELSE 0 END AS mtime, CASE WHEN doc_id % 9 = 0 THEN source || ' x' WHEN doc_id % 9 < 3 THEN source END AS path FROM documents")
def parse_records(spark, d):
    r = _lines(spark, d).withColumn("r", text.parse_record(F.col("line"), hashes=False))
    return r.selectExpr("doc_id", "r.type", "coalesce(r.num, -1) as num", "coalesce(r.mtime, 0) as mtime", "r.path")


@query("SELECT doc_id, '/a/' || doc_id || '/' || doc_id % 7 AS path FROM documents")
def clean_paths(spark, d):
    raw = F.expr("concat('/../a/./', doc_id, '//b/../c/', source, '/../..//', doc_id % 7, '/')")
    return table(spark, d, "documents").select("doc_id", text.clean_path(raw).alias("path"))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * CAST(1048576 AS BIGINT) WHEN 3 THEN p_size * CAST(1073741824 AS BIGINT) WHEN 4 THEN p_size * CAST(1099511627776 AS BIGINT) ELSE -1 END AS bytes FROM part")
def parse_size(spark, d):
    s = F.expr("concat(p_size, case p_partkey % 8 when 0 then '' when 1 then 'K' when 2 then 'm' when 3 then 'G' when 4 then 't' when 5 then 'X' when 6 then 'MB' else '8388608T' end)")
    return table(spark, d, "part").select("p_partkey", F.coalesce(text.parse_size(s), F.lit(-1)).alias("bytes"))


@query(
    "WITH v AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * CAST(power(1024, o_orderkey % 4) AS BIGINT) // CASE WHEN o_orderkey % 7 = 0 THEN 1000000 ELSE 1 END AS v FROM orders), "
    "u AS (SELECT *, CASE WHEN v < 1024 THEN 0 WHEN v < 1048576 THEN 1 WHEN v < 1073741824 THEN 2 WHEN v < 1099511627776 THEN 3 WHEN v < 1125899906842624 THEN 4 ELSE 5 END AS u FROM v) "
    "SELECT o_orderkey, v, CASE WHEN u = 0 THEN v || ' B' ELSE (v // CAST(power(1024, u) AS BIGINT)) || '.' || ((v // CAST(power(1024, u - 1) AS BIGINT)) % 1024 * 10 // 1024) || ' ' || ['KiB', 'MiB', 'GiB', 'TiB', 'PiB'][u] END AS human FROM u"
)
def human_bytes(spark, d):
    v = F.expr("cast(round(o_totalprice * 100) as bigint) * cast(power(1024, o_orderkey % 4) as bigint) div if(o_orderkey % 7 = 0, 1000000, 1)")
    return table(spark, d, "orders").select("o_orderkey", v.alias("v")).withColumn("human", text.human_bytes(F.col("v")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS time, strftime(o_orderdate, '%Y%m%d%H%M') AS stamp, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS back FROM orders")
def time_text(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", text.time_text(F.col("o_orderdate")).alias("time"), text.time_stamp(F.col("o_orderdate")).alias("stamp"))
    return o.withColumn("back", text.time_from_stamp(F.col("stamp")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'scan-unknown' ELSE 'scan-' || strftime(o_orderdate, '%Y%m%d%H%M') END AS name FROM orders")
def archive_name(spark, d):
    started = F.when(F.col("o_orderkey") % 6 == 0, "soon").otherwise(text.time_text(F.col("o_orderdate")))
    return table(spark, d, "orders").select("o_orderkey", text.archive_name(started).alias("name"))


# Lines of lists, headers and commands.


@query(
    f"WITH {pair_sql()}, e AS (SELECT path, type, size, errno, hash FROM o) SELECT path, "
    "CASE WHEN type = 'E' THEN concat_ws(' ', 'E', errno, '-', path) ELSE concat_ws(' ', type, size, octet_length(encode(path)), path) END AS tree_line, "
    "CASE WHEN type = 'E' THEN concat_ws(' ', 'E', errno, '-', path) ELSE concat_ws(' ', type, hash, size, path) END AS hash_line FROM e"
)
def list_lines(spark, d):
    rows = pairs.origin(spark, d).withColumn("mtime", F.octet_length("path")).withColumn("name", F.col("path").cast("binary"))
    return rows.select("path", lines.tree_line("name").cast("string").alias("tree_line"), lines.hash_line("name").cast("string").alias("hash_line"))


@query(f"WITH {pair_sql()} SELECT dest, path, concat_ws(' ', status, CASE WHEN ot IS NULL THEN '-' WHEN ot = 'E' THEN CAST(oe AS VARCHAR) ELSE oh END, CASE WHEN dt IS NULL THEN '-' WHEN dt = 'E' THEN CAST(de AS VARCHAR) ELSE dh END, path) AS line, status || ' ' || path AS short FROM j WHERE status IS NOT NULL")
def diff_lines(spark, d):
    rows = _star(spark, d).withColumn("name", F.col("path").cast("binary"))
    return rows.select("dest", "path", lines.diff_line("name").cast("string").alias("line"), lines.status_line("name").cast("string").alias("short"))


@query("SELECT page_id, regexp_replace(url, '/$', '') || '/' || page_id AS joined, 'page' || CASE WHEN page_id % 3 = 1 THEN '' ELSE 's' END AS counted FROM pages")
def join_paths(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", text.join_path(F.col("url"), F.col("page_id").cast("string")).alias("joined"), F.concat(F.lit("page"), text.plural(F.col("page_id") % 3)).alias("counted"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) END AS value FROM events")
def header_values(spark, d):
    line = F.concat(F.lit("# "), "event_type", F.lit(": "), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", text.header_value(line, "click").alias("value"))


@query(
    f"WITH {pair_sql()} SELECT a.path, a.type = b.type AND CASE WHEN a.type = 'E' THEN a.errno IS NOT DISTINCT FROM b.errno ELSE a.size IS NOT DISTINCT FROM b.size AND a.hash IS NOT DISTINCT FROM b.hash END AS same "
    "FROM o a JOIN d b ON a.path = b.path AND b.dest = 'destination-1'"
)
def results_equal(spark, d):
    cols = ["type", "size", "errno", "hash"]
    a = pairs.origin(spark, d).select("path", F.struct(*cols).alias("a"))
    b = pairs.destination(spark, d).select("path", F.struct(*cols).alias("b"))
    return a.join(b, "path").select("path", compare.results_equal("a", "b").alias("same"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'fast gap=' || p_partkey || ' block=65536 profile=ssd seek_bytes=200000' END AS mode, "
    r"'rsync -a -I --from0 --files-from=''' || replace(p_name, '''', '''\''''') || ''' ''/o/'' ''/d/''' AS command FROM part"
)
def content_commands(spark, d):
    p = table(spark, d, "part")
    fast = F.format_string(sampling.mode_line(True, 0, 65536, "ssd", 200_000).replace("gap=0", "gap=%d"), "p_partkey")
    return p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, sampling.mode_line(False)).otherwise(fast).alias("mode"), report.content_command(F.col("p_name"), F.lit("/o/"), F.lit("/d/")).alias("command"))


@query("SELECT side, path FROM (SELECT l_returnflag AS side, l_suppkey AS path, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS r FROM lineitem) WHERE r = 1")
def first_seen(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("side"), F.col("l_suppkey").alias("path"))
    return recheck.first_seen(rows, ["R", "N", "A"])


@query(
    f"WITH {_EVENTS}, n AS (SELECT side, path, event_id % 7 + 1 AS cost, row_number() OVER (PARTITION BY side ORDER BY path) - 1 AS pos FROM e), s AS (SELECT *, sum(cost) OVER (PARTITION BY side ORDER BY path) - cost AS spent FROM n) "
    "SELECT side, path, pos, CAST(spent // 100 AS BIGINT) AS chunk FROM s"
)
def cost_chunks(spark, d):
    costly = table(spark, d, "events").select(F.col("event_type").alias("side"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"), (F.col("event_id") % 7 + 1).alias("cost"))
    return ordered.with_position(spark, costly, by=["side"], cost="cost").select("side", "path", "pos", ordered.chunk_of(F.col("spent"), 100).alias("chunk"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
