"""A training-data pipeline of the llm operators; every stage is written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeparity.llm.decontaminate import remove_hits
from treeparity.llm.language import identify_language
from treeparity.llm.mixing import mix_sources, mixed_rows
from treeparity.llm.near_dedup import near_duplicate_rows
from treeparity.llm.sharding import hilbert_shards
from treeparity.scratch import Scratch


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` as c0, c1 .., whatever its columns are named, and the names there of id and text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: those without text or without a letter.

    Rows are judged one by one, equal ones alike; a null id or language does not matter. Where
    nothing can be learned from, every row goes.
    """
    rows, _, text = _numbered(docs)
    found = identify_language(spark, rows, docs.select("doc_id", "text", "lang"), text)
    return found.where("lang_pred <> 'und'").select(*rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates stays: that with the smallest doc_id.

    Of rows of that id, one of the text with the smallest hash stays, and of those that repeat its
    text the first by all columns. A row without shingles stands alone and stays, but for its
    repetitions. Rows of one id in different components each stay or go with their own component.
    """
    rows = near_duplicate_rows(spark, docs).where("kept")
    one = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("text_key", "doc_id")).alias("k"), F.count("*").alias("n"))
    one = one.select(F.col("k.doc_id").alias("id"), F.col("k.text_key").alias("key"), (F.col("n") > 1).alias("tied"))
    alone = rows.where("component is null").groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg((F.count("*") > 1).alias("tied"))
    kept = Scratch(spark, "kept").table(one.unionByName(alone), "rows")
    numbered, doc_id, text = _numbered(docs)
    same = numbered[doc_id].cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("key"))
    left = numbered.join(kept, same)
    if kept.where("tied").isEmpty():
        return left.select(*numbered.columns).toDF(*docs.columns)
    first = left.where("tied").groupBy("id", "key").agg(F.min(F.struct(*numbered.columns)).alias("r")).select("r.*")
    return left.where("not tied").select(*numbered.columns).unionByName(first).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, each row by its own text; null and empty texts stay."""
    return remove_hits(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document that is taken twice is two rows.

    Documents without words go, as there is nothing to take from them; rows that share an id are
    taken each for itself, and a null source is a source.
    """
    rows, doc_id, text = _numbered(docs)
    mixed = mix_sources(rows, doc_id, rows.columns[docs.columns.index("source")], text)
    return mixed_rows(mixed, text).select(*rows.columns).toDF(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, text_crc32, shard and slot (columns of these names are replaced).

    Every row has a slot of its own, also one that repeats another or has a null id or text.
    """
    return hilbert_shards(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_id),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL cannot express these stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
