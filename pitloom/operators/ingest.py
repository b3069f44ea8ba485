"""Turning what sources deliver into rows: bars, vintages, filed facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitloom.functions.safe import finite

PRICES = ["open", "high", "low", "close"]


def normalise_bars(df: DataFrame, names: dict[str, str], ticker: Column, arrival: str, zone: str = "UTC") -> DataFrame:
    """Vendor bars in our columns, one a ticker and day.

    ``names`` maps vendor columns to ours (date, open, high, low, close, perhaps adj_close, volume); other columns are left
    out. A missing adj_close is the close, a missing volume 0, the day is the one in ``zone``; rows without all four prices
    are dropped, and of a day's rows the one of the greatest ``arrival`` stays (equal ones: the greatest prices).
    """
    lacking = {"date", *PRICES, "volume"} - set(names.values())
    if lacking:
        raise ValueError(f"missing columns: {sorted(lacking)}")
    raw = df.select(ticker.alias("ticker"), F.col(arrival).alias("_arrival"), *(F.col(v).alias(o) for v, o in names.items()))
    adjusted = finite(F.col("adj_close")) if "adj_close" in raw.columns else F.lit(None).cast("double")
    rows = raw.select(
        "ticker", "_arrival", F.to_date(F.from_utc_timestamp(F.col("date").cast("timestamp"), zone)).alias("trade_date"),
        *(finite(F.col(c)).alias(c) for c in PRICES), adjusted.alias("adj_close"), F.coalesce(F.col("volume").cast("long"), F.lit(0).cast("long")).alias("volume"),
    ).na.drop(subset=["trade_date", *PRICES])
    rows = rows.withColumn("adj_close", F.coalesce("adj_close", "close"))
    last = F.max(F.struct("_arrival", *PRICES, "adj_close", "volume")).alias("_l")
    return rows.groupBy("ticker", "trade_date").agg(last).select("ticker", "trade_date", *(F.col(f"_l.{c}").alias(c) for c in [*PRICES, "adj_close", "volume"]))


def vintages_from_intervals(df: DataFrame, series: str = "series_id", observed: str = "observation_date", begin: str = "realtime_start", end: str = "realtime_end", value: str = "value") -> DataFrame:
    """(series_id, observation_date, vintage_date, value) from observations with the period each value was in force.

    Vintages are the series' distinct begins; a vintage holds, of each observation in force then, the one that began last
    (equal begins: the greatest value). Each interval is turned into the run of vintage numbers it spans, so the join is on
    equal keys; rows whose dates cannot be read are left out.
    """
    day = lambda c: F.col(c).try_cast("date")
    rows = df.select(F.col(series).alias("s"), day(observed).alias("o"), day(begin).alias("b"), day(end).alias("e"), F.col(value).cast("double").alias("x")).where("s IS NOT NULL AND o IS NOT NULL AND b IS NOT NULL AND e IS NOT NULL AND b <= e")
    order = Window.partitionBy("s").orderBy("v")
    numbered = rows.select("s", F.col("b").alias("v")).distinct().withColumn("k", F.row_number().over(order))
    starts = rows.join(numbered.select("s", F.col("v").alias("b"), F.col("k").alias("first")), ["s", "b"])
    # the last vintage at or before the end: dates of ends and vintages in one narrow order, one row a date
    dates = rows.select("s", F.col("e").alias("v"), F.lit(0).alias("m")).unionByName(numbered.select("s", "v", F.lit(1).alias("m"))).groupBy("s", "v").agg(F.max("m").alias("m"))
    counts = dates.select("s", F.col("v").alias("e"), F.sum("m").over(order).alias("last"))
    spans = starts.join(counts, ["s", "e"]).select("s", "o", "b", "x", F.explode(F.sequence(F.col("first"), F.col("last"))).alias("k"))
    held = spans.groupBy("s", "o", "k").agg(F.max(F.struct("b", "x")).alias("l"))
    return held.join(numbered, ["s", "k"]).select(F.col("s").alias("series_id"), F.col("o").alias("observation_date"), F.col("v").alias("vintage_date"), F.col("l.x").alias("value"))


def latest_only(df: DataFrame, series: str = "series_id", observed: str = "observation_date") -> DataFrame:
    """All observations as one vintage a series, dated by the last observation."""
    last = df.groupBy(series).agg(F.max(observed).alias("vintage_date"))
    return df.drop("vintage_date").join(last, series)


def effective_vintage(df: DataFrame, never_revised: Column) -> DataFrame:
    """For series that are never revised the vintage is the observation's own date."""
    return df.withColumn("vintage_date", F.when(never_revised, F.col("observation_date")).otherwise(F.col("vintage_date")))


FACT = "start string, end string, val string, fy string, fp string, form string, filed string, frame string"


def _level(text: Column, kind: str) -> Column:
    """The text read as an object or list of texts, or null if it is of another shape."""
    return F.when(F.substring(F.ltrim(text), 1, 1) == ("[" if kind.startswith("array") else "{"), F.from_json(text, kind))


def flatten_facts(df: DataFrame, document: str, key: str) -> DataFrame:
    """Filed facts from nested documents: namespace, tag, unit and their rows, levels of another shape skipped.

    Each level is parsed by itself, so that what has another shape is left out alone, with nothing beside it. Rows need end,
    filed and form; form is cut to 16 characters, blank fiscal period and frame are null, as are values that are no number.
    Documents that are no JSON give no rows.
    """
    objects = "map<string,string>"
    a = df.select(F.col(key).alias("ticker"), F.explode(_level(F.get_json_object(document, "$.facts"), objects)).alias("namespace", "_x"))
    b = a.select("ticker", "namespace", F.explode(_level(F.col("_x"), objects)).alias("tag", "_x"))
    c = b.select("ticker", "namespace", "tag", F.explode(_level(_level(F.col("_x"), objects)["units"], objects)).alias("unit", "_x"))
    d = c.select("ticker", "namespace", "tag", "unit", F.explode(_level(F.col("_x"), "array<string>")).alias("_x"))
    e = d.select("ticker", "namespace", "tag", "unit", _level(F.col("_x"), FACT).alias("r"))
    blank = lambda n: F.nullif(F.trim(f"r.{n}"), F.lit(""))
    return e.select(
        "ticker", "namespace", "tag", "unit", F.col("r.start").try_cast("date").alias("period_start"), F.col("r.end").try_cast("date").alias("period_end"), F.col("r.filed").try_cast("date").alias("filed"),
        F.substring("r.form", 1, 16).alias("form"), F.col("r.fy").try_cast("int").alias("fiscal_year"), blank("fp").alias("fiscal_period"), blank("frame").alias("frame"), finite(F.col("r.val").try_cast("double")).alias("value"),
    ).where("period_end IS NOT NULL AND filed IS NOT NULL AND form IS NOT NULL")


def tag_table(spark: SparkSession, tags: list[str]) -> DataFrame:
    """(namespace, tag), each once, of texts ``namespace:tag``; texts without both are left out."""
    part = lambda k: F.split_part("t", F.lit(":"), F.lit(k))
    listed = spark.createDataFrame([(t,) for t in tags], "t string").select(part(1).alias("namespace"), part(2).alias("tag"))
    return listed.where("namespace <> '' AND tag <> ''").distinct()


def curated(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """Facts of the tags in ``tags`` (namespace, tag): an equi-join on both; a list's size is known to the planner."""
    return facts.join(tags.select("namespace", "tag").distinct(), ["namespace", "tag"], "left_semi")
