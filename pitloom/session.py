"""Session builder and the two settings every operator reads from the session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "pitloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow on; ``conf`` overrides (dots as ``__``)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def together(*steps: Callable[[], DataFrame]) -> list[DataFrame]:
    """Results of steps that run jobs of their own and do not need each other, side by side."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder for tables of this session, deleted when its JVM ends.

    It is in the folder that the cluster names in spark.checkpoint.dir, so its tables outlive executors. Where none is set
    that is the checkpoint folder of the context or the warehouse's, and with a local master (tests, a single machine) a
    temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        alone = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        spare = os.path.join(tempfile.gettempdir(), "pitloom") if alone else spark.conf.get("spark.sql.warehouse.dir")
        root = known.get() if known.isDefined() else spare
    path = f"{root.rstrip('/')}/pitloom-{uuid.uuid4().hex}"
    Folder(spark, path).delete_on_exit()
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: what is used more than once is computed once."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of any file system that the cluster's Hadoop configuration knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(""))) if self.fs.exists(self._at("")) else []

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_text(self, name: str, text: str) -> bool:
        """Writes a new file whole or not at all; False if there is one of that name."""
        beside = f".{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(beside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.exists(self._at(name)) and self.fs.rename(self._at(beside), self._at(name)):
            return True
        self.fs.delete(self._at(beside), False)
        return False

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._at(name), True)

    def delete_on_exit(self) -> None:
        self.fs.deleteOnExit(self._at(""))
