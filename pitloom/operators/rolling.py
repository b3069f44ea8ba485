"""Totals and averages over trailing calendar periods, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(df: DataFrame, entity: str, date: str, value: str, version: str | None = None) -> DataFrame:
    """(entity, day, value): of several rows of a day the one of the greatest ``version`` is in force; without one they add up.

    Equal versions fall back to the greatest value, null below all. A null value counts as 0. Rows without date or entity
    are left out.
    """
    rows = df.where(F.col(date).isNotNull() & F.col(entity).isNotNull())
    amount = F.coalesce(F.col(value), F.lit(0))
    last = F.max(F.struct(F.col(version).alias("v"), F.col(value).alias("x")))["x"] if version else F.sum(amount)
    return (
        rows.groupBy(F.col(entity).alias("entity"), F.col(date).alias("day"))
        .agg(last.alias("value"))
        .withColumn("value", F.coalesce("value", F.lit(0)))
    )


def trailing(daily: DataFrame, periods: tuple[int, ...] = (7, 30), block_days: int = 256) -> DataFrame:
    """For each entity and calendar day from its first to its last day: total_N and mean_N over the N days that end on it.

    Input: (entity, day, value), one row a day. Each day's value is exploded onto the days it influences; the rows of an
    entity are first brought together by blocks of ``block_days``, so that nearly all of the explosion is summed before it
    is shuffled and an entity with a long history is spread over many tasks. Calendar rows then give zeros to the days that
    nothing influences. Also returned: ``first_day`` and ``value`` of the day itself (0 without one). ``mean_N`` divides by N.
    An empty table gives no rows.
    """
    longest = max(periods)
    block = F.floor(F.unix_date("day") / block_days)
    placed = daily.repartition("entity", block)
    reach = placed.select("entity", "value", "day", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("after"))
    totals = reach.groupBy("entity", F.date_add("day", F.col("after")).alias("day")).agg(
        *(F.sum(F.when(F.col("after") < n, F.col("value"))).alias(f"total_{n}") for n in periods),
        F.sum(F.when(F.col("after") == 0, F.col("value"))).alias("value"),
    )
    ends = daily.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    calendar = ends.select("entity", "first_day", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return calendar.join(totals, ["entity", "day"], "left").select(
        "entity", "day", "first_day", zero("value"), *(zero(f"total_{n}") for n in periods),
        *((F.coalesce(f"total_{n}", F.lit(0)) / n).alias(f"mean_{n}") for n in periods),
    )
