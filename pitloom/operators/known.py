"""Attributes as they were known at the time of an event, by version numbers instead of a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_known(events: DataFrame, changes: DataFrame, keys: list[str], event_date: str, change_date: str, attributes: list[str]) -> DataFrame:
    """``events`` with ``known_<attribute>`` of the last change at or before the event's date; null where there is none.

    ``changes`` has one row per (keys, change_date). Each change gets its number in the key's order; each (keys, date) that
    events or changes have gets the count of changes so far, over narrow distinct rows, one a date; these join the wide
    attributes on equal keys and number, and the events take over what their key and date has. The sorted groups hold one row a date, however many events or repeated
    changes a key has. Events with a null key or date know nothing. The events' own columns are kept, but for any that is
    already called ``known_<attribute>``.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    change = changes.where(F.col(change_date).isNotNull()).select(
        *(F.col(k).alias(n) for k, n in zip(keys, ks)), F.col(change_date).alias("at"), *(F.col(a).alias(f"a{i}") for i, a in enumerate(attributes))
    )
    numbered = change.withColumn("number", F.row_number().over(Window.partitionBy(*ks).orderBy("at")).cast("long"))
    dates = (
        events.where(F.col(event_date).isNotNull())
        .select(*(F.col(k).alias(n) for k, n in zip(keys, ks)), F.col(event_date).alias("at"), F.lit(0).alias("change"))
        .unionByName(change.select(*ks, "at", F.lit(1).alias("change")))
        .groupBy(*ks, "at").agg(F.max("change").alias("change"))
    )
    counts = dates.select(*ks, "at", F.sum("change").over(Window.partitionBy(*ks).orderBy("at")).alias("number"))
    attributes_of = numbered.select(*ks, "number", *(f"a{i}" for i in range(len(attributes))))
    # the wide attributes meet the narrow rows, so that the events themselves are shuffled once
    states = counts.join(attributes_of, [*ks, "number"], "left").select(*ks, "at", *(f"a{i}" for i in range(len(attributes))))
    known = [f"known_{a}" for a in attributes]
    kept = [c for c in events.columns if c not in known]
    # the events' own columns travel as one struct, so that none of their names can clash
    e = events.select(*(F.col(k).alias(n) for k, n in zip(keys, ks)), F.col(event_date).alias("at"), F.struct(*(F.col(c) for c in kept)).alias("event"))
    return e.join(states, [*ks, "at"], "left").select("event.*", *(F.col(f"a{i}").alias(n) for i, n in enumerate(known)))


def vintage_changes(vintages: DataFrame, series: str = "series_id", observed: str = "observation_date", vintage: str = "vintage_date", value: str = "value") -> DataFrame:
    """(series, on, vintage, observed, value): each date from which another (vintage, observation) is the latest known one.

    A vintage supersedes the ones before with all its observations. Of those up to its own date the last is known at once;
    one that it dates ahead becomes the latest on its own date, if no later vintage has come by then. A vintage that holds
    nothing up to its date leaves nothing known until then. Repeated rows count once; of different values of one
    observation in one vintage the greatest counts. Rows without series, observation or vintage are left out.
    """
    rows = vintages.where(F.col(series).isNotNull() & F.col(observed).isNotNull() & F.col(vintage).isNotNull()).select(
        F.col(series).alias("series"), F.col(vintage).alias("vintage"), F.col(observed).alias("observed"), F.col(value).alias("value")
    )
    states = rows.groupBy("series", "vintage", F.greatest("vintage", "observed").alias("on")).agg(F.max(F.struct("observed", "value")).alias("last"))
    published = states.groupBy("series", "vintage").agg(F.min("on").alias("first_on"))
    order = Window.partitionBy("series").orderBy("vintage")
    spans = published.withColumn("until", F.lead("vintage").over(order))
    held = states.join(spans.select("series", "vintage", "until"), ["series", "vintage"]).where(F.col("until").isNull() | (F.col("on") < F.col("until")))
    nothing = spans.where(F.col("first_on") > F.col("vintage")).select(
        "series", F.col("vintage").alias("on"), F.lit(None).cast("date").alias("vintage"), F.lit(None).cast("date").alias("observed"), F.lit(None).cast("double").alias("value")
    )
    return held.select("series", "on", "vintage", F.col("last.observed").alias("observed"), F.col("last.value").cast("double").alias("value")).unionByName(nothing)


def filing_changes(facts: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q")) -> DataFrame:
    """(ticker, namespace, tag, filed, value, period_end): what each filing date makes known.

    Only annual and quarterly reports, with a value, on periods that had ended. Of one filing date the latest period_end
    counts, then the longest period (one without a start is the shortest), then the greatest value.
    """
    length = F.coalesce(F.date_diff("period_end", "period_start"), F.lit(-1))
    return (
        facts.where(F.col("form").isin(*forms) & F.col("value").isNotNull() & (F.col("period_end") <= F.col("filed")))
        .groupBy("ticker", "namespace", "tag", "filed")
        .agg(F.max(F.struct("period_end", length.alias("length"), "value")).alias("last"))
        .select("ticker", "namespace", "tag", "filed", F.col("last.value").alias("value"), F.col("last.period_end").alias("period_end"))
    )
