"""Queries p8 to p10 over the reviews. SQL cannot express them; tests hold them against brute force and other libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitloom.llm import encode, leak, split
from pitloom.session import read


def _documents(spark: SparkSession, base: str) -> DataFrame:
    """Ids and texts. A file of fewer row groups than the session has cores is dealt out, as texts are work for Python."""
    docs = read(spark, base, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode.encode_corpus(_documents(spark, base), "doc_id", "text")


def p9_passages(spark: SparkSession, base: str) -> DataFrame:
    return leak.leaked_passages(_documents(spark, base), "doc_id", "text", read(spark, base, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return p9_passages(spark, base).select("doc_id", "item_id").distinct()


def p10_pieces(spark: SparkSession, base: str) -> DataFrame:
    return split.split_corpus(_documents(spark, base), "doc_id", "text")


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return p10_pieces(spark, base).where("piece_no = 1").select("doc_id")


QUERIES = {f.__name__: f for f in (p8_ids, p9_found, p9_passages, p10_found, p10_pieces)}
SQL: dict[str, str] = {}
