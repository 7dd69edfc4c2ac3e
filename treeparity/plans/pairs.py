"""Relations shaped like trees, made from the driver tables: an origin and edited copies of it.

By doc_id modulo 50 (shifted for each destination), a document is missing, edited in place, one
character longer, a link or unreadable in a destination, unreadable in the origin, or has a
companion that only the destination has. The same relations are given in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Destinations and the shift of their slots; without one, the copy is exact.
DESTS = {"destination-1": 0, "destination-2": 7, "destination-3": None}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("path"), "text")


def _facts(df: DataFrame, *keep: str) -> DataFrame:
    readable = F.col("type") != "E"
    return df.select(
        *keep, "path", "type",
        F.when(readable, F.octet_length("t").cast("bigint")).alias("size"),
        F.when(~readable, 13).alias("errno"),
        F.when(readable, F.md5(F.col("t").cast("binary"))).alias("hash"),
    )


def origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir)
    return _facts(docs.withColumn("type", F.when((F.col("doc_id") % 50).isin(5, 7), "E").otherwise("F")).withColumnRenamed("text", "t"))


def destination(spark: SparkSession, sf_dir: str, shift: int | None = 0) -> DataFrame:
    s = source(spark, sf_dir).withColumn("slot", F.lit(49) if shift is None else (F.col("doc_id") + shift) % 50)
    edited = F.when(F.col("slot") == 1, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).when(F.col("slot") == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    kind = F.when(F.col("slot") == 3, "L").when(F.col("slot") == 4, "E").otherwise("F")
    kept = s.where("slot not in (0, 7)").select("path", kind.alias("type"), edited.alias("t"))
    extra = s.where("slot in (6, 8)").select(F.concat("path", F.lit(".new")).alias("path"), F.when(F.col("slot") == 8, "E").otherwise("F").alias("type"), F.col("text").alias("t"))
    return _facts(kept.unionByName(extra))


def destinations(spark: SparkSession, sf_dir: str, add: int = 0) -> DataFrame:
    parts = [destination(spark, sf_dir, None if x is None else x + add).withColumn("dest", F.lit(name)) for name, x in DESTS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in DESTS], "dest string")


def entries_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the files of a large tree; times are the days of shipping in seconds."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("path"),
        F.lit("F").alias("type"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("size"),
        (F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400).alias("mtime"),
        F.lit(None).cast("int").alias("errno"),
    )


def pair_sql(add: int = 0, name: str = "") -> str:
    """The CTEs src, o, d, j (joined and classified, all destinations) of a WITH clause."""
    shifts = ", ".join(f"('{n}', {'NULL' if x is None else x + add})" for n, x in DESTS.items())
    facts = "CASE WHEN type <> 'E' THEN octet_length(encode(t)) END AS size, CASE WHEN type = 'E' THEN 13 END AS errno, CASE WHEN type <> 'E' THEN md5(t) END AS hash"
    return f"""
src{name} AS (SELECT doc_id, source || '/' || doc_id AS path, text FROM documents),
o{name} AS (SELECT path, type, {facts} FROM (SELECT path, text AS t, CASE WHEN doc_id % 50 IN (5, 7) THEN 'E' ELSE 'F' END AS type FROM src{name})),
names{name} AS (SELECT * FROM (VALUES {shifts}) AS v(dest, shift)),
s{name} AS (SELECT dest, path, text, CASE WHEN shift IS NULL THEN 49 ELSE (doc_id + shift) % 50 END AS slot FROM src{name}, names{name}),
d{name} AS (SELECT dest, path, type, {facts} FROM (
  SELECT dest, path, CASE slot WHEN 3 THEN 'L' WHEN 4 THEN 'E' ELSE 'F' END AS type,
         CASE slot WHEN 1 THEN '#' || substr(text, 2) WHEN 2 THEN text || 'x' ELSE text END AS t FROM s{name} WHERE slot NOT IN (0, 7)
  UNION ALL SELECT dest, path || '.new', CASE slot WHEN 8 THEN 'E' ELSE 'F' END, text FROM s{name} WHERE slot IN (6, 8))),
j{name} AS (SELECT coalesce(a.dest, b.dest) AS dest, coalesce(a.path, b.path) AS path, a.type AS ot, b.type AS dt, a.hash AS oh, b.hash AS dh, a.errno AS oe, b.errno AS de,
  CASE WHEN a.type = 'E' THEN 'ERR-SRC' WHEN b.type IS NULL THEN 'MISSING' WHEN a.type IS NULL THEN 'EXTRA' WHEN b.type = 'E' THEN 'ERR-DST'
       WHEN (a.type = 'L') <> (b.type = 'L') THEN 'TYPE' WHEN a.size <> b.size THEN 'SIZE' WHEN a.hash <> b.hash THEN 'HASH' END AS status
  FROM (SELECT n.dest, o{name}.* FROM o{name}, names{name} n) a FULL OUTER JOIN d{name} b ON a.dest = b.dest AND a.path = b.path)
"""
