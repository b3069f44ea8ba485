"""Readers of the files a pipeline meets: parquet trees, seeds, registries, nested documents."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_tree(spark: SparkSession, *globs: str) -> DataFrame:
    """All parquet files under the globs, with the union of their columns."""
    return spark.read.option("mergeSchema", True).parquet(*globs)


def seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV seed with a header; empty cells are null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="", emptyValue="")


def mart(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A mart's parquet, or an empty table of its schema where there is none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], schema)
    return df.select(*columns) if columns else df


def rows_of(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(values))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, name) from a text file with one name a line: comments after #, upper case, each once, in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("position", "line"))
    name = F.upper(F.trim(F.split_part("line", F.lit("#"), F.lit(1))))
    return lines.select("position", name.alias("name")).where("name <> ''").groupBy("name").agg(F.min("position").alias("position")).select("position", "name")


def tag_list(spark: SparkSession, path: str) -> DataFrame:
    """(namespace, tag), each once, from a JSON file that lists ``namespace:tag`` texts under ``tags``."""
    raw = spark.read.json(path, multiLine=True).select(F.explode("tags").alias("t"))
    part = lambda k: F.split_part("t", F.lit(":"), F.lit(k))
    return raw.select(part(1).alias("namespace"), part(2).alias("tag")).where("tag <> ''").distinct()


def registry(path: str) -> dict:
    """A registry file, JSON or (where a parser for it is installed) YAML, read on the driver: registries are written by hand."""
    with open(path) as f:
        text = f.read()
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def series_registry(spark: SparkSession, path: str, latest_only: str | None = None) -> DataFrame:
    """(position, series_id, title, category, mode): series by category, ``latest`` for those the second file lists, else ``full``.

    The first file holds ``series``: categories with lists of {id, title}; the second, which may be missing, ``series``: ids.
    """
    found = registry(path)
    if not isinstance(found, dict) or not isinstance(found.get("series"), dict):
        raise ValueError(f"{path} has no categories under series")
    second = registry(latest_only).get("series", []) if latest_only and os.path.exists(latest_only) else []
    once, rows = {str(s) for s in second}, []
    for category, entries in found["series"].items():
        for e in entries if isinstance(entries, list) else [entries]:
            if not isinstance(e, dict) or "id" not in e:
                raise ValueError(f"an entry under {category} in {path} has no id: {e!r}")
            sid = str(e["id"])
            rows.append((len(rows), sid, str(e.get("title", sid)), str(category), "latest" if sid in once else "full"))
    return spark.createDataFrame(rows, "position int, series_id string, title string, category string, mode string")


def documents(spark: SparkSession, glob: str) -> DataFrame:
    """(path, document): whole JSON texts, for operators.ingest.flatten_facts."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
