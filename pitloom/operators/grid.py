"""Irregular readings onto a regular grid, of equal steps of time or of Mondays to Fridays, by validity intervals."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weekday_of(day: Column) -> Column:
    """The day itself from Monday to Friday; for a weekend the Monday after."""
    return F.when(F.weekday(day) >= 5, F.next_day(day, "Mon")).otherwise(day)


def _cell_start(day: Column) -> Column:
    """First day of the cell of a weekday: a Monday's begins on the Saturday before."""
    return F.when(F.weekday(day) == 0, F.date_sub(day, 2)).otherwise(day)


def weekday_grid(df: DataFrame, series: str, date: str, value: str, order: str, hold_days: int = 1) -> DataFrame:
    """(series, day, value, coverage, filled, missing) for each Monday to Friday from a series' first to its last reading.

    A reading is valid from its date until the next one, for ``hold_days`` at most; readings without a value are none, but
    they count for the first and last date. The cell of a day is the day, of a Monday also the weekend before. ``value`` is
    the time-weighted average of the intervals within the cell, ``coverage`` the fraction of the cell they cover, ``filled``
    the last value at or before the day, ``missing`` marks a cell without a value. Of several readings of a date the one of
    the greatest ``order`` counts. Rows without series or date are left out; an empty table gives no rows.
    """
    rows = df.where(F.col(series).isNotNull() & F.col(date).isNotNull()).select(
        F.col(series).alias("series"), F.col(date).alias("at"), F.col(value).cast("double").alias("x"), F.col(order).alias("o")
    )
    dated = rows.groupBy("series", "at").agg(F.max_by("x", F.when(F.col("x").isNotNull(), F.struct("o", "x"))).alias("x"))
    one = Window.partitionBy("series").orderBy("at")
    steps = dated.where(F.col("x").isNotNull()).withColumn("until", F.least(F.date_add("at", hold_days), F.coalesce(F.lead("at").over(one), F.date_add("at", hold_days))))
    days = F.filter(F.sequence(weekday_of(F.col("at")), weekday_of(F.date_sub("until", 1))), lambda d: F.weekday(d) < 5)
    parts = steps.select("series", "x", "at", "until", F.explode(days).alias("day"))
    start, end = _cell_start(F.col("day")), F.date_add("day", 1)
    overlap = F.date_diff(F.least("until", end), F.greatest("at", start))
    cells = (
        parts.withColumn("w", overlap).where(F.col("w") > 0)
        .groupBy("series", "day")
        .agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("value"), F.sum("w").alias("w"))
    )
    ends = dated.groupBy("series").agg(weekday_of(F.min("at")).alias("first"), weekday_of(F.max("at")).alias("last"))
    grid = ends.select("series", F.explode(F.filter(F.sequence("first", "last"), lambda d: F.weekday(d) < 5)).alias("day"))
    return grid.join(cells, ["series", "day"], "left").select(
        "series", "day", "value",
        (F.coalesce("w", F.lit(0)) / F.date_diff(end, start)).alias("coverage"),
        F.last("value", ignorenulls=True).over(Window.partitionBy("series").orderBy("day")).alias("filled"),
        F.col("w").isNull().alias("missing"),
    )


def time_grid(
    df: DataFrame, series: str, at: str, value: str, order: str, step: timedelta, hold: timedelta, origin: timedelta = timedelta(0), block_cells: int = 4096
) -> DataFrame:
    """(series, cell, value, coverage, filled, missing) for each cell of length ``step`` from a series' first to its last reading.

    ``cell`` is the timestamp at which it begins, cells being counted from ``origin`` after 1970. A reading, of a date or
    timestamp in ``at``, is valid until the next one with a value, for ``hold`` at most; its interval is cut by the cells.
    ``value`` is the time-weighted average of the intervals within the cell, ``coverage`` the fraction of the cell they cover,
    ``filled`` the cell's value or that of the last cell that has one, ``missing`` marks a cell without. Of several readings of one time the
    one of the greatest ``order`` counts, of equal ones the greatest. Readings without a value (or with NaN) are none, but
    count for the first and last cell. Rows without series or time are left out; an empty table gives no rows.

    A series is sorted in blocks of ``block_cells`` cells; only one row a block tells what the blocks before and after hold,
    so that no task has a whole series.
    """
    length, held, start = (int(x / timedelta(microseconds=1)) for x in (step, hold, origin))
    if length <= 0 or held <= 0 or block_cells < 1:
        raise ValueError("step, hold and block_cells must be positive")
    x = F.col(value).cast("double")
    rows = df.where(F.col(series).isNotNull() & F.col(at).isNotNull()).select(
        F.col(series).alias("series"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.when(~F.isnan(x), x).alias("x"), F.col(order).alias("o")
    )
    cell = lambda t: F.expr(f"({t} - {start} - pmod({t} - {start}, {length})) DIV {length}")
    block = lambda k: F.expr(f"({k} - pmod({k}, {block_cells})) DIV {block_cells}")
    dated = rows.groupBy("series", "t").agg(F.max_by("x", F.when(F.col("x").isNotNull(), F.struct("o", "x"))).alias("x"))
    ends = dated.groupBy("series").agg(F.min(cell("t")).alias("first"), F.max(cell("t")).alias("last"))
    known = dated.where(F.col("x").isNotNull()).withColumn("cell", cell("t")).withColumn("block", block("cell"))
    # the next reading: in the block, else the first of the blocks after
    blocks = Window.partitionBy("series").orderBy("block")
    heads = known.groupBy("series", "block").agg(F.min("t").alias("t")).select("series", "block", F.lead("t").over(blocks).alias("after"))
    within = known.withColumn("next", F.lead("t").over(Window.partitionBy("series", "block").orderBy("t")))
    steps = within.join(heads, ["series", "block"]).select("series", "t", "x", F.least(F.col("t") + held, F.coalesce("next", "after")).alias("until"))
    parts = steps.select("series", "t", "x", "until", F.explode(F.sequence(cell("t"), cell("(until - 1)"))).alias("cell"))
    begin = F.col("cell") * length + start
    overlap = F.least("until", begin + length) - F.greatest("t", begin)
    cells = parts.withColumn("w", overlap).groupBy("series", "cell").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("value"), F.sum("w").alias("w"))
    # the grid is made block by block
    spans = ends.select("series", "first", "last", F.explode(F.sequence(block("first"), block("last"))).alias("block"))
    grid = spans.select("series", "block", F.explode(F.sequence(F.greatest("first", F.col("block") * block_cells), F.least("last", (F.col("block") + 1) * block_cells - 1))).alias("cell"))
    filled = grid.join(cells, ["series", "cell"], "left")
    tails = cells.withColumn("block", block("cell")).groupBy("series", "block").agg(F.max_by("value", "cell").alias("value"))
    carried = spans.select("series", "block").join(tails, ["series", "block"], "left").select("series", "block", F.last("value", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    run = Window.partitionBy("series", "block").orderBy("cell")
    return filled.join(carried, ["series", "block"]).select(
        "series", F.timestamp_micros(begin).alias("cell"), "value", (F.coalesce("w", F.lit(0)) / length).alias("coverage"),
        F.coalesce(F.last("value", ignorenulls=True).over(run), "carried").alias("filled"), F.col("w").isNull().alias("missing"),
    )
