"""Content-addressed snapshots: what was written before is not written again.

Data files lie under ``<root>/data`` by entity and hash; the manifest is a table of its own, one row a snapshot. Hashing,
the comparison with the manifest and the write are distributed; entities are never walked on the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.functions.hashing import content_hash
from pitloom.session import Folder, cut

MANIFEST = "entity string, hash string, written_at timestamp, n_rows long, first_date date, last_date date"


@dataclass(frozen=True)
class SnapshotStore:
    """Snapshots of ``entity`` under ``root``; ``parts`` are the hashed expressions, so columns left out may differ freely.

    ``entity`` is one column or several (a series and its vintage); an entity's name is the column's text, or a JSON list of
    the texts. Rows without a (whole) entity are left out.
    """

    root: str
    entity: str | tuple[str, ...]
    date: str
    parts: tuple[Column, ...]

    def name(self, *values: Column) -> Column:
        texts = [v.cast("string") for v in values]
        known = reduce(lambda a, b: a & b, (t.isNotNull() for t in texts))
        return F.when(known, texts[0] if len(texts) == 1 else F.to_json(F.array(*texts)))

    def manifest(self, spark: SparkSession) -> DataFrame:
        """One row a snapshot that was in force: its entity, hash, when, rows and span."""
        try:
            return spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], MANIFEST)

    def latest(self, spark: SparkSession) -> DataFrame:
        """(entity, hash): the last snapshot written."""
        return self.manifest(spark).groupBy("entity").agg(F.max_by("hash", F.struct("written_at", "hash")).alias("hash"))

    def missing(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        """Those of ``wanted`` (entity) that have no snapshot yet: what an ingest limited to the missing has to fetch."""
        return wanted.select("entity").distinct().join(self.manifest(spark).select("entity"), "entity", "left_anti")

    def write(self, df: DataFrame, written_at: Column | None = None) -> DataFrame:
        """Stores the entities whose content differs from their last snapshot; (entity, hash, status) of all of them.

        Content that an entity had before, and has again, gets a new row in the manifest and no data. Data is written by
        whole snapshots, each replacing what an attempt that failed may have left, and is named in the manifest after it is
        complete. Files are of even size: small snapshots share a task, a large one is split.
        """
        spark, keys = df.sparkSession, [self.entity] if isinstance(self.entity, str) else list(self.entity)
        rows = df.withColumn("_entity", self.name(*(F.col(k) for k in keys))).where("_entity IS NOT NULL")
        spans = rows.groupBy("_entity").agg(F.min(self.date).cast("date").alias("first_date"), F.max(self.date).cast("date").alias("last_date"))
        hashes = content_hash(rows, ["_entity"], list(self.parts)).join(spans, "_entity")
        known = self.latest(spark).select(F.col("entity").alias("_entity"), F.col("hash").alias("_old"))
        had = self.manifest(spark).select(F.col("entity").alias("_entity"), F.col("hash").alias("content_hash"), F.lit(True).alias("_had")).distinct()
        judged = hashes.join(known, "_entity", "left").join(had, ["_entity", "content_hash"], "left").select(
            F.col("_entity").alias("entity"), F.col("content_hash").alias("hash"), "n_rows", "first_date", "last_date",
            F.when(F.col("_old") == F.col("content_hash"), "skipped").otherwise("written").alias("status"), F.coalesce("_had", F.lit(False)).alias("had"),
        )
        judged = cut(judged)  # fixed before the store changes
        new = judged.where("status = 'written'")
        data = rows.join(new.where(~F.col("had")).select(F.col("entity").alias("_entity"), F.col("hash").alias("_hash")), "_entity")
        Folder(spark, self.root).create_text("schema.json", data.schema.json())
        data.hint("rebalance", F.col("_entity"), F.col("_hash")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_entity", "_hash").parquet(f"{self.root}/data")
        when = written_at if written_at is not None else F.current_timestamp()
        new.select("entity", "hash", when.alias("written_at"), "n_rows", "first_date", "last_date").write.mode("append").parquet(f"{self.root}/manifest")
        return judged.select("entity", "hash", "status")

    def _data(self, spark: SparkSession) -> DataFrame:
        # partition values are texts whatever they look like
        return spark.read.schema(self._schema(spark)).parquet(f"{self.root}/data")

    def _schema(self, spark: SparkSession) -> T.StructType:
        try:
            found = spark.read.parquet(f"{self.root}/data").schema
        except AnalysisException as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            # nothing but empty snapshots so far: the schema of the first
            found = T.StructType.fromJson(json.loads(Folder(spark, self.root).read_text("schema.json")))
        text = {"_entity", "_hash"}
        return T.StructType([T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in found])

    def read_latest(self, spark: SparkSession) -> DataFrame:
        """The rows of every entity's last snapshot."""
        last = self.latest(spark).select(F.col("entity").alias("_entity"), F.col("hash").alias("_hash"))
        return self._data(spark).join(last, ["_entity", "_hash"], "left_semi").drop("_entity", "_hash")

    def read_entity(self, spark: SparkSession, *values: object) -> DataFrame:
        """The rows of one entity's last snapshot, such as one vintage of a series; only its files are read."""
        name = self.name(*(F.lit(v) for v in values))
        last = self.latest(spark).where(F.col("entity") == name).select(F.col("entity").alias("_entity"), F.col("hash").alias("_hash"))
        return self._data(spark).where(F.col("_entity") == name).join(last, ["_entity", "_hash"], "left_semi").drop("_entity", "_hash")


def retained(manifest: DataFrame, entity: list[str], path: str = "path") -> DataFrame:
    """(entity..., path): of each entity's snapshots the one with the greatest last_date, then written_at, then path."""
    return manifest.groupBy(*entity).agg(F.max_by(path, F.struct("last_date", "written_at", path)).alias(path))
