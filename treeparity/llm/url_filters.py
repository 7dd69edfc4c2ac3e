"""URL filters by a temporal list join, with DataFrame operations only.

Dated list entries (a domain is listed as ``block`` or ``allow``, or taken off with ``remove``)
become validity intervals; every capture's host and its parent domains are joined with the
intervals that hold at fetch time, and the entry of the longest domain decides. Captures are
reduced to distinct (host, day) before the join, so a host with a third of all rows is one key
of a few rows there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import columns
from .html_text import host_of


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(domain, list, action, valid_from, valid_to) of (domain, list, action, listed_on).

    An entry holds from its date until the next entry of its domain and list; on one day, the last
    by action's code point (remove, then block, then allow counts as earlier) decides. Null
    domains, dates or actions are no entries. valid_to is null for those that still hold.
    """
    kept = entries.where("domain is not null and listed_on is not null and action is not null")
    day = kept.groupBy(F.lower("domain").alias("domain"), "list", "listed_on").agg(F.max("action").alias("action"))
    later = Window.partitionBy("domain", "list").orderBy("listed_on")
    return day.withColumn("valid_to", F.lead("listed_on").over(later)).where("action <> 'remove'").select("domain", "list", "action", F.col("listed_on").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched_on") -> DataFrame:
    """Every row of ``captures`` with host, domain, list, action (of the entry that decides, else null) and blocked.

    Among entries of one domain, block beats allow, then the list's code point decides. A null or
    malformed URL has an empty host and a null date none that hold: neither is blocked.
    """
    own = columns.others(captures, "host", "domain", "list", "action", "blocked")
    rows = captures.select(columns.packed(own), host_of(url_col).alias("host"), columns.column(fetched_col).alias("fetched"))
    seen = rows.select("host", "fetched").where("host <> '' and fetched is not null").distinct()
    parents = "transform(sequence(1, size(p)), i -> array_join(slice(p, i, size(p) - i + 1), '.'))"
    domains = seen.withColumn("p", F.split("host", r"\.")).select("host", "fetched", F.explode(F.expr(parents)).alias("domain"))
    holds = domains.join(validity_intervals(entries), "domain").where("fetched >= valid_from and (valid_to is null or fetched < valid_to)")
    best = holds.groupBy("host", "fetched").agg(F.max(F.struct(F.length("domain").alias("n"), "action", "list", "domain")).alias("b"))
    out = rows.join(best, ["host", "fetched"], "left").select(*columns.unpacked(own), "host", "b.domain", "b.list", "b.action")
    return out.withColumn("blocked", F.coalesce(F.col("action") == "block", F.lit(False)))


def _draw(what: str, n: int) -> F.Column:
    return F.conv(F.substring(F.md5(F.expr(what)), 1, 6), 16, 10).cast("int") % n


def demo_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages`` and their parents, drawn by hash; for the query."""
    hosts = pages.select(host_of().alias("host")).distinct().where("host <> ''").withColumn("p", F.split("host", r"\."))
    domain = hosts.select(F.explode(F.expr("transform(sequence(1, greatest(1, size(p) - 1)), i -> array_join(slice(p, i, size(p) - i + 1), '.'))")).alias("domain")).distinct()
    base = domain.select("domain", _draw("domain", 300).alias("d"), _draw("concat(domain, '#')", 4).alias("k"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), F.col("d") + n)
    return (
        base.select("domain", F.lit("spam").alias("list"), F.when(F.col("k") == 3, "allow").otherwise("block").alias("action"), day(0).alias("listed_on"))
        .union(base.where("k = 1").select("domain", F.lit("spam"), F.lit("remove"), day(60)))
        .union(base.where("k = 1 and d % 2 = 0").select("domain", F.lit("spam"), F.lit("block"), day(120)))
    )


def op2_query(pages: DataFrame) -> DataFrame:
    """Captures are fetched on 2024-01-01 plus page_id modulo 400 days."""
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 400).cast("int")).alias("fetched_on"))
    found = filter_urls(captures, demo_entries(pages))
    return found.select("page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"), "domain", "list", "action", "blocked")


OP2_SQL = r"""
WITH c AS (
  SELECT page_id, coalesce(regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1)), '\.+$', ''), '') AS host,
         DATE '2024-01-01' + CAST(page_id % 400 AS INTEGER) AS fetched_on
  FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM c WHERE host <> ''),
domains AS (SELECT DISTINCT array_to_string(p[i:len(p)], '.') AS domain FROM (SELECT p, unnest(range(1, greatest(1, len(p) - 1) + 1)) AS i FROM hosts)),
drawn AS (SELECT domain, CAST(('0x' || substr(md5(domain), 1, 6)) AS INTEGER) % 300 AS d, CAST(('0x' || substr(md5(domain || '#'), 1, 6)) AS INTEGER) % 4 AS k FROM domains),
entries AS (
  SELECT domain, 'spam' AS list, CASE WHEN k = 3 THEN 'allow' ELSE 'block' END AS action, DATE '2024-01-01' + d AS listed_on FROM drawn
  UNION ALL SELECT domain, 'spam', 'remove', DATE '2024-01-01' + d + 60 FROM drawn WHERE k = 1
  UNION ALL SELECT domain, 'spam', 'block', DATE '2024-01-01' + d + 120 FROM drawn WHERE k = 1 AND d % 2 = 0),
days AS (SELECT domain, list, listed_on, max(action) AS action FROM entries GROUP BY ALL),
intervals AS (SELECT *, lead(listed_on) OVER (PARTITION BY domain, list ORDER BY listed_on) AS valid_to FROM days),
asked AS (SELECT page_id, host, fetched_on, array_to_string(p[i:len(p)], '.') AS domain
  FROM (SELECT c.*, string_split(host, '.') AS p, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host <> '')),
held AS (
  SELECT a.page_id, i.domain, i.list, i.action,
         row_number() OVER (PARTITION BY a.page_id ORDER BY length(i.domain) DESC, i.action DESC, i.list DESC) AS r
  FROM asked a JOIN intervals i ON a.domain = i.domain AND a.fetched_on >= i.listed_on AND (i.valid_to IS NULL OR a.fetched_on < i.valid_to)
  WHERE i.action <> 'remove')
SELECT c.page_id, c.host, CAST(c.fetched_on AS VARCHAR) AS fetched_on, h.domain, h.list, h.action, coalesce(h.action = 'block', false) AS blocked
FROM c LEFT JOIN held h ON c.page_id = h.page_id AND h.r = 1
"""
