"""Versions of changing attributes with their validity, kept by rebuilding only the chains that an update touches."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pitloom.session import Folder


def plain_words(text: Column) -> Column:
    """Lower case, only letters, words parted by one blank; null if no letter is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(""))


@dataclass(frozen=True)
class Snapshots:
    """Columns of the periodic snapshots: key, its date, the order of delivery, tracked attributes, stated validity."""

    key: str = "ticker"
    date: str = "snapshot_date"
    delivered: str = "delivered_at"
    attributes: tuple[str, ...] = ("sector", "is_benchmark")
    valid_from: str = "valid_from"
    valid_to: str = "valid_to"

    def names(self) -> list[str]:
        return [self.key, self.date, self.delivered, *self.attributes, self.valid_from, self.valid_to]


def versions(raw: DataFrame, columns: Snapshots = Snapshots()) -> DataFrame:
    """(key, version, attributes..., valid_from, valid_to): the whole chain of every key in ``raw``; valid_to null is open.

    Per key and snapshot date the last delivered row holds (equal deliveries: the greatest row). Snapshots follow by date.
    A null attribute means as before, and at the start the first one known. A version begins at the first row, where an
    attribute differs, or at a row without valid_to after a row with one; it is valid from the date its first row states,
    else from that snapshot's date, and to the first valid_to stated in it, else to the day before the next version.
    Rows without key or date are left out. A key has one row a snapshot date in the sort, however often it was delivered.
    """
    c = columns
    held = F.struct(F.col(c.delivered).alias("d"), *(F.col(a).alias(f"a{i}") for i, a in enumerate(c.attributes)), F.col(c.valid_from).alias("vf"), F.col(c.valid_to).alias("vt"))
    rows = (
        raw.where(F.col(c.key).isNotNull() & F.col(c.date).isNotNull())
        .groupBy(F.col(c.key).alias("k"), F.col(c.date).alias("s"))
        .agg(F.max(held).alias("h"))
        .select("k", "s", "h.*")
    )
    order = Window.partitionBy("k").orderBy("s")
    names = [f"a{i}" for i in range(len(c.attributes))]
    known = rows.select(
        "k", "s", "vf", "vt",
        *(F.coalesce(F.last(a, ignorenulls=True).over(order), F.first(a, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias(a) for a in names),
    )
    begins = F.row_number().over(order) == 1
    for a in names:
        begins = begins | ~F.col(a).eqNullSafe(F.lag(a).over(order))
    begins = begins | (F.col("vt").isNull() & F.lag("vt").over(order).isNotNull())
    marked = known.withColumn("begins", begins.cast("int")).withColumn("version", F.sum("begins").over(order))
    chain = marked.groupBy("k", "version").agg(
        F.min_by(F.struct(*names), "s").alias("a"),
        F.min_by(F.coalesce("vf", "s"), "s").alias("valid_from"),
        F.min_by("vt", F.when(F.col("vt").isNotNull(), F.col("s"))).alias("stated"),
    )
    following = F.lead("valid_from").over(Window.partitionBy("k").orderBy("version"))
    return chain.select(
        F.col("k").alias(c.key), "version", *(F.col(f"a.{n}").alias(a) for n, a in zip(names, c.attributes)), "valid_from",
        F.coalesce("stated", F.date_sub(following, 1)).alias("valid_to"),
    )


def rebuild_touched(history: DataFrame, raw: DataFrame, updates: DataFrame, columns: Snapshots = Snapshots()) -> DataFrame:
    """The history after ``updates``: chains of the touched keys anew from all their raw rows, all others as they are.

    ``raw`` holds the rows known before; rows of ``updates`` may be late, corrected or repeated. Only the columns that
    ``columns`` names are read.
    """
    names = columns.names()
    touched = updates.select(columns.key).distinct()
    theirs = raw.select(*names).join(touched, columns.key, "left_semi").unionByName(updates.select(*names))
    return history.join(touched, columns.key, "left_anti").unionByName(versions(theirs, columns))


class ChainStore:
    """A history on a shared file system, of which an update replaces the chains it touches and nothing else.

    Keys lie in ``buckets`` by hash. Raw rows are appended as a table for each batch; the history has a table for each
    replacement, split by bucket, and a pointer file names the table in force of every bucket and the batches taken in. A
    batch reads the raw rows of its buckets, rebuilds the chains of its keys and writes its buckets anew; then the next
    numbered pointer is created by a rename, so a reader sees all touched chains replaced or none. Only one writer can create
    a number: another one fails, and its batch can be given again. A batch that was taken in before changes nothing. What a
    replacement leaves unused is removed by the next one, so readers have that time to finish.

    ``root`` may be on any file system that the session's Hadoop configuration knows; nothing is kept on the driver. The
    number of ``buckets`` is fixed when a store is made. The raw rows of a bucket are put together once they are in
    ``most_tables`` tables, so the pointer stays small: its size is set by the buckets and writers.
    """

    def __init__(self, spark: SparkSession, root: str, columns: Snapshots = Snapshots(), buckets: int = 64, most_tables: int = 16):
        self.spark, self.root, self.columns, self.buckets, self.most_tables = spark, root.rstrip("/"), columns, buckets, most_tables
        self.folder = Folder(spark, self.root)

    def _pointers(self) -> list[str]:
        return [n for n in self.folder.names() if n.startswith("pointer-")]

    def state(self) -> dict:
        """The pointer in force: its number, each writer's last batch, the history's table and raw tables of every bucket."""
        names = self._pointers()
        return json.loads(self.folder.read_text(names[-1])) if names else {"number": 0, "writers": {}, "history": {}, "raw": {}, "schemas": {}, "left": []}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.columns.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _tables(self, paths: list[str], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, part: str = "history") -> DataFrame:
        """The history, or the ``raw`` rows, in force."""
        return self._of(self.state(), part, None)

    def _of(self, state: dict, part: str, buckets: list[str] | None) -> DataFrame:
        if not state["schemas"]:
            raise ValueError(f"nothing was put into {self.root} yet")
        tables = [f"{self.root}/{t}/_bucket={b}" for b, names in state[part].items() if buckets is None or b in buckets for t in ([names] if isinstance(names, str) else names)]
        return self._tables(tables, state["schemas"][part])

    def _write(self, df: DataFrame, table: str) -> None:
        # a large bucket is split and small ones share a task
        df.withColumn("_bucket", self._bucket()).hint("rebalance", F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{table}")

    def apply(self, updates: DataFrame, writer: str | None = None, batch: int = 0) -> None:
        """Takes in new, late or corrected rows. A writer's batches are numbered upwards: one that is not above its last is a repetition."""
        state, writer = self.state(), writer or uuid.uuid4().hex
        if state["writers"].get(writer, -1) >= batch:
            return
        number, attempt = state["number"] + 1, uuid.uuid4().hex[:8]
        raw_table, history_table, merged_table = (f"{kind}-{number:08d}-{attempt}" for kind in ("raw", "history", "merged"))
        rows = updates.select(*self.columns.names()).where(F.col(self.columns.key).isNotNull())
        schemas = state["schemas"] or {"raw": rows.schema.json(), "history": versions(rows, self.columns).schema.json()}
        self._write(rows, raw_table)
        touched = self._held(raw_table)
        own = lambda buckets: self._tables([f"{self.root}/{raw_table}/_bucket={b}" for b in buckets], schemas["raw"])
        if any(b in state["history"] for b in touched):
            chains = rebuild_touched(self._of(state, "history", touched), self._of(state, "raw", touched), own(touched), self.columns)
        else:
            chains = versions(own(touched), self.columns)
        self._write(chains, history_table)
        held = self._held(history_table)
        full = [b for b in touched if len(state["raw"].get(b, [])) >= self.most_tables]
        if full:
            self._write(self._of(state, "raw", full).unionByName(own(full)), merged_table)
        left = [f"{state['history'][b]}/_bucket={b}" for b in held if b in state["history"]] + [f"{t}/_bucket={b}" for b in full for t in [*state["raw"][b], raw_table]]
        following = {
            "number": number, "writers": state["writers"] | {writer: batch}, "schemas": schemas, "left": left, "history": state["history"] | {b: history_table for b in held},
            "raw": state["raw"] | {b: [merged_table] if b in full else [*state["raw"].get(b, []), raw_table] for b in touched},
        }
        if not self.folder.create_text(f"pointer-{number:08d}.json", json.dumps(following)):
            for table in (raw_table, history_table, merged_table):
                self.folder.delete(table)
            raise RuntimeError(f"another writer has changed {self.root}: give the batch again")
        for name in [*state["left"], *self._pointers()[:-2]]:
            self.folder.delete(name)

    def _held(self, table: str) -> list[str]:
        return [n.split("=")[1] for n in Folder(self.spark, f"{self.root}/{table}").names() if n.startswith("_bucket=")]
