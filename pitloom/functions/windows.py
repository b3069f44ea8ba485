"""Window expressions over a series in date order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pitloom.functions.safe import ratio


def by_date(*keys: str, date: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(date)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def log_return(x: Column, w: WindowSpec, n: int = 1) -> Column:
    """Natural log of x over the value n rows before; null at the start and for values that are not positive."""
    before = F.lag(x, n).over(w)
    return F.when((x > 0) & (before > 0), F.ln(x / before))


def momentum(x: Column, w: WindowSpec, n: int) -> Column:
    return ratio(x, F.lag(x, n).over(w)) - 1


def volatility(r: Column, w: WindowSpec, n: int, per_year: int = 252) -> Column:
    """Sample standard deviation of the last n rows, a year's; null unless all n are there."""
    last = last_rows(w, n)
    return F.when(F.count(r).over(last) == n, F.stddev_samp(r).over(last) * F.sqrt(F.lit(float(per_year))))


#: Rows in which the inverse decay of Wilder's average stays far within a double.
RSI_BLOCK = 512


def wilder_rsi(df: DataFrame, keys: list[str], change: str, out: str, n: int = 14, date: str = "trade_date") -> DataFrame:
    """``df`` with the relative strength index by Wilder's recursive averages (weight 1/n, first change in full).

    ``change`` is null on a series' first row. The averages' common decay cancels in gain over loss, so both are running sums
    weighted by the inverse decay. These start anew every RSI_BLOCK rows; what the blocks before leave is carried on, as a
    pair of numbers and the logarithm of their common factor, so that a series may be of any length and may rest for as
    long. Null before n changes and where nothing ever moved; 100 without losses. A missing change counts as none.
    """
    w = by_date(*keys, date=date)
    decay, position, block = math.log(1 - 1 / n), F.col("_position"), F.col("_block")
    spots = df.withColumn("_position", F.row_number().over(w) - 2).withColumn("_block", F.floor(F.greatest(position, F.lit(0)) / RSI_BLOCK))
    weight = F.when(position == 0, 1.0).otherwise(F.exp(-decay * (position - RSI_BLOCK * block)) / n)
    inner = Window.partitionBy(*keys, "_block").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    side = lambda x: F.sum(F.greatest(x, F.lit(0.0)) * weight).over(inner)
    sums = spots.select("*", side(F.col(change)).alias("_gain"), side(-F.col(change)).alias("_loss"))
    ended = F.when(F.lead("_block").over(w) != block, F.struct(F.col("_gain").alias("g"), F.col("_loss").alias("l")))
    marked = sums.select("*", ended.alias("_ended"), F.count(change).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_n"))
    past = marked.withColumn("_past", F.collect_list("_ended").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    pair = lambda g, l, s: F.struct(g.alias("g"), l.alias("l"), s.alias("s"))  # noqa: E731,E741
    zero, fade = F.lit(0.0), F.lit(RSI_BLOCK * decay)

    def carry(old: Column, x: Column) -> Column:
        f = F.exp(old["s"])
        return F.when(x["g"] + x["l"] > 0, pair(x["g"] + old["g"] * f, x["l"] + old["l"] * f, fade)).otherwise(pair(old["g"], old["l"], old["s"] + fade))

    held = past.withColumn("_held", F.aggregate("_past", pair(zero, zero, zero), carry))
    moves = F.col("_gain") + F.col("_loss") > 0
    both = lambda s, k: F.when(moves, F.col(s) + F.col(f"_held.{k}") * F.exp("_held.s")).otherwise(F.col(f"_held.{k}"))
    gain, loss = both("_gain", "g"), both("_loss", "l")
    rsi = F.when(loss == 0, F.when(gain > 0, 100.0)).otherwise(100 - 100 / (1 + ratio(gain, loss)))
    return held.select(*df.columns, F.when(F.col("_n") >= n, rsi).alias(out))
