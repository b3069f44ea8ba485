"""A batch source of daily bars from local files, behind the interface a network client would have."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ticker string, date string, open string, high string, low string, close string, adj_close string, volume string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class _Ticker(InputPartition):
    def __init__(self, ticker: str, path: str):
        self.ticker, self.path = ticker, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.start, self.end = options.get("start", ""), options.get("end", "9999-12-31")
        asked = options.get("tickers", "")
        self.tickers = [t for t in asked.split(",") if t] or sorted(f[:-4] for f in os.listdir(self.root) if f.endswith(".csv"))

    def partitions(self) -> list[InputPartition]:
        return [_Ticker(t, os.path.join(self.root, f"{t}.csv")) for t in self.tickers]

    def read(self, partition: _Ticker) -> Iterator[tuple]:
        if not os.path.exists(partition.path):
            return  # a ticker that the source does not have gives no rows
        with open(partition.path, newline="") as f:
            for row in csv.DictReader(f):
                if self.start <= (row.get("date") or "")[:10] <= self.end:
                    yield (partition.ticker, *((row.get(c) or None) for c in _COLUMNS[1:]))


class DailyBars(DataSource):
    """``spark.read.format("daily_bars").load(folder)``: one CSV a ticker; options tickers, start, end (inclusive)."""

    @classmethod
    def name(cls) -> str:
        return "daily_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DailyBars)
