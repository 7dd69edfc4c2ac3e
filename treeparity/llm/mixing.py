"""Mixing sources to target weights, with DataFrame operations only.

Documents get a hash-random key; within a source they are in order of that key, dealt to ranges
of it. Token counts are summed up over ranges first and inside each range after, so that no task
holds a source. Weights go by the sources' ranks, and what sources at their limit leave is shared
again by sums over all sources, so that no task sorts them either. A source's documents are taken in that order, whole epochs first, and cut at the
source's exact budget: the document that crosses it gives only a part of its words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch
from . import columns, order

#: Ranges of the key are told by its first hexadecimal digits, as many as make ranges of some RANGE_BYTES of a source with all rows.
RANGE_DIGITS = (3, 6)
RANGE_BYTES = 64 << 20
#: Sources that one task ranks.
SOURCES_IN_TASK = 200_000
EPOCHS = 3
_SPACE = r"[\x20\x09-\x0D]"


def n_words(text: str = "text") -> Column:
    """Number of runs of anything but ASCII white space; 0 for null.

    Each run with the white space around it becomes one character, which are counted: no array of
    a long text's words is made.
    """
    word = _SPACE.replace("[", "[^") + "+"
    count = F.length(F.regexp_replace(text, f"{_SPACE}*{word}{_SPACE}*", "x"))
    return F.when(F.col(text).rlike(_SPACE.replace("[", "[^")), count).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, epochs: int = EPOCHS) -> DataFrame:
    """(sk, source_size, target) of rows (sk, size); sk is the source as a key that is never null.

    Sources in order of code point, null last, weigh 1, 2, 3, repeating, and share the sum of all
    sizes; a target stops at ``epochs`` times its source's size and the excess is shared again by
    weight, until none is above. Each sharing is one sum over the sources.
    """
    s = scratch.table(sizes.groupBy("sk").agg(F.sum("size").alias("source_size")), "sources").withColumn("last", F.col("sk") == "n")
    s, _ = order.ranked(s, ["last", "sk"], scratch, "ranks", 1 + s.count() // SOURCES_IN_TASK)
    s = s.withColumn("w", (F.col("rank") % 3 + 1).cast("long")).withColumn("per", F.lit(float(epochs)) * F.col("source_size") / F.col("w"))
    s = scratch.table(s.select("sk", "source_size", "w", "per"), "weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, before = -1.0, None
    while level != before:
        free = F.col("per") > F.lit(level)
        sums = s.agg(F.sum(F.when(~free, F.col("source_size"))).alias("full"), F.sum(F.when(free, F.col("w"))).alias("w")).first()
        if not sums["w"]:
            break
        before, level = level, float(total - epochs * (sums["full"] or 0)) / sums["w"]
    most = F.lit(float(epochs)) * F.col("source_size")
    return s.select("sk", "source_size", F.when(F.col("per") <= F.lit(level), most).otherwise(F.col("w") * F.lit(level)).cast("double").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", epochs: int = EPOCHS, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and taken (columns of these names are replaced).

    ``keep`` names the other columns to return, all by default; what is not kept is not shuffled.
    Sizes are words; null and empty texts have none and nothing is taken from them. The sum of a
    source's taken is its target rounded. A null source is a source of its own. Rows are ordered
    by a key of their id and text, then id and size; rows equal in all that are interchangeable.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own = [c for c in columns.others(docs, "size", "source_size", "target", "taken") if keep is None or c in keep]
    key = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))), F.lit(seed))), 1, 16)
    sk = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    given = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    digits = max(RANGE_DIGITS[0], min(RANGE_DIGITS[1], math.ceil(math.log(max(given / RANGE_BYTES, 1), 16))))
    rows = docs.select(columns.packed(own), F.col(id_col).alias("id"), n_words(text_col).alias("size"), sk.alias("sk"), key.alias("key"))
    rows = scratch.table(rows, "sized").withColumn("range", F.substring("key", 1, digits))
    sums = scratch.table(rows.groupBy("sk", "range").agg(F.sum("size").alias("size")), "sums")
    targets = source_targets(sums, scratch, epochs)
    ahead = Window.partitionBy("sk").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), zero)).drop("size").join(targets, "sk")
    within = Window.partitionBy("sk", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(within), zero))
    placed = placed.join(sums, ["sk", "range"]).withColumn("budget", F.least(F.round("target").cast("long"), epochs * F.col("source_size")))
    rest = F.expr("budget - (budget div source_size) * source_size - ahead - within")
    taken = F.expr("(budget div source_size) * size") + F.greatest(zero, F.least(F.col("size"), rest))
    return placed.select(*columns.unpacked(own), "size", "source_size", "target", F.when(F.col("source_size") > 0, taken).otherwise(zero).alias("taken"))


def mixed_rows(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and the cut one with the first words only.

    Rows that are not taken at all, those without words among them, are not in it; equal rows are
    each taken for themselves.
    """
    pieces = rf"split({text_col}, '(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])')"  # a word and the white space after it each
    copy = columns.free(mixed.columns)
    lead = rf"if({text_col} rlike '^[\\x20\\x09-\\x0D]', 1, 0)"
    head = F.expr(f"array_join(slice({pieces}, 1, cast(taken % size as int) + {lead}), '')")
    copies = mixed.where("size > 0 and taken > 0").withColumn(copy, F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
    return copies.withColumn(text_col, F.when(F.col(copy) * F.col("size") > F.col("taken"), head).otherwise(F.col(text_col))).drop(copy)


def op4_query(docs: DataFrame) -> DataFrame:
    return mix_sources(docs.select("doc_id", "source", "text"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS sk, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':mix'), 1, 16) AS k
  FROM documents),
s0 AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk),
s1 AS (SELECT *, (row_number() OVER (ORDER BY sk = 'n', sk) - 1) % 3 + 1 AS w FROM s0),
s2 AS (SELECT *, CAST(3 AS DOUBLE) * source_size / w AS per FROM s1),
s3 AS (SELECT *, CAST((SELECT sum(source_size) FROM s0) - 3 * coalesce(sum(source_size) OVER (ORDER BY per, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / ((SELECT sum(w) FROM s1) - coalesce(sum(w) OVER (ORDER BY per, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s2),
s4 AS (SELECT *, (SELECT max(level) FROM s3 WHERE per > level) AS free FROM s3),
s5 AS (SELECT sk, source_size, CASE WHEN free IS NULL OR per <= level THEN CAST(3 AS DOUBLE) * source_size ELSE w * free END AS target FROM s4),
p AS (SELECT d.*, source_size, target, least(CAST(round(target) AS BIGINT), 3 * source_size) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.sk ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN s5 ON d.sk = s5.sk)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CASE WHEN source_size > 0 THEN CAST((budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) AS BIGINT) ELSE 0 END AS taken
FROM p
"""
