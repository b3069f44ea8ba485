"""Fetching documents by address, spread over the tasks of a job, with retries and a pause between requests.

The transport is a parameter, so that it can be exchanged; the standard one uses the Python library. What is fetched are whole
JSON texts, which operators.ingest turns into rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib import error, request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transport = Callable[[str, dict[str, str]], tuple[int, str]]


def standard_transport(address: str, headers: dict[str, str]) -> tuple[int, str]:
    """(status, text); an answer with a status of its own is no error."""
    try:
        with request.urlopen(request.Request(address, headers=headers), timeout=60) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


@dataclass(frozen=True)
class Fetcher:
    """How documents are asked for: waits (seconds) before each further try, pause after every request, headers."""

    transport: Transport = standard_transport
    waits: tuple[float, ...] = (1.0, 4.0, 16.0)
    pause: float = 0.0
    headers: tuple[tuple[str, str], ...] = ()

    def one(self, address: str) -> tuple[int | None, str | None, str | None]:
        """(status, text, error): tried again on a broken connection, on 429 and on 5xx; never raises."""
        status, text, said = None, None, None
        for wait in (*self.waits, None):
            try:
                status, text = self.transport(address, dict(self.headers))
                said = None if status == 200 else f"status {status}"
            except Exception as e:  # noqa: BLE001 - reported with the request
                status, text, said = None, None, f"{type(e).__name__}: {e}"[:300]
            if self.pause:
                time.sleep(self.pause)
            if wait is None or (status is not None and status != 429 and status < 500):
                break
            time.sleep(wait)
        return status, text if status == 200 else None, said


def fetch(requests: DataFrame, key: str, address: str, fetcher: Fetcher = Fetcher(), tasks: int = 4) -> DataFrame:
    """(key, status, document, error) of every request; a failure is a row and not an end. ``tasks`` bounds how many run at once."""
    kind = dict(requests.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, a in zip(batch["key"], batch["address"]):
                status, text, said = fetcher.one(a)
                yield pd.DataFrame({"key": [k], "status": pd.array([status], dtype="Int32"), "document": [text], "error": [said]})

    asked = requests.where(F.col(address).isNotNull()).select(F.col(key).alias("key"), F.col(address).alias("address")).repartition(tasks, "address")
    return asked.mapInPandas(run, f"key {kind}, status int, document string, error string").withColumnRenamed("key", key)


def observations(documents: DataFrame, key: str = "series_id", document: str = "document") -> DataFrame:
    """(series_id, observation_date, realtime_start, realtime_end, value) as texts, from documents with a list ``observations``."""
    row = "array<struct<date:string,realtime_start:string,realtime_end:string,value:string>>"
    listed = documents.select(F.col(key).alias("series_id"), F.explode(F.from_json(F.get_json_object(document, "$.observations"), row)).alias("o"))
    return listed.select("series_id", F.col("o.date").alias("observation_date"), "o.realtime_start", "o.realtime_end", "o.value")
