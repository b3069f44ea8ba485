"""Readings a source's series cannot have had: impossible values, spikes that do not last, readings that hang.

Bars of a series are put in date order once. Mergeable quantile sketches of the day-to-day log changes are kept per source,
series and context; bars being daily, contexts are the weekday, which recurs as an hour of the day would, and the calendar
month, for restless times. The weekdays' sketches are merged into the series' own. A reading is a spike if it stands out from
the readings on both sides by more than the expanded interquartile ranges of the series, of its weekday and of its month.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Fence:
    """Widths in interquartile ranges of log changes: of the whole series, of the month, of the weekday; the least log change; downwards too."""

    series: float
    month: float
    weekday: float
    change: float = 0.0
    down: bool = False


@dataclass(frozen=True)
class SpikeRules:
    fences: dict[str, Fence] = field(
        default_factory=lambda: {"close": Fence(5.0, 2.5, 3.0, down=True), "high": Fence(6.0, 3.0, 3.6), "volume": Fence(2.7, 0.5, 1.6, change=1.82)}
    )
    #: An interquartile range below this is taken for this (a pegged price has none).
    least_range: float = 0.0005
    run: int = 7
    #: A series hangs only if fewer than this share of its readings repeat the one before.
    still: float = 0.5
    #: A context of fewer changes has no range of its own, as the suspect's two or three would make it: the series' is taken.
    least_changes: int = 8
    #: Size of the sketches: exact for series of up to so many readings, beyond that with a rank error of some 2 / size.
    sketch: int = 512


def _ignoring(function: str, name: str, offset: int, window: str) -> Column:
    return F.expr(f"{function}({name}, {offset}) IGNORE NULLS OVER ({window})")


def _bars(df: DataFrame, rules: SpikeRules) -> DataFrame:
    """One row per (source, ticker, trade_date): the last delivered reading of each field that is not null."""
    order = F.struct("load_id", "row_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return (
        df.select("source", "ticker", "trade_date", "load_id", "row_id", *(F.col(c).cast("double").alias(c) for c in ("open", "close", "high", "volume")))
        .where(F.col("trade_date").isNotNull())
        .groupBy("source", "ticker", "trade_date")
        .agg(*(last(c) for c in ("open", "close", "high", "volume")))
    )


def spike_cases(df: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """(source, ticker, trade_date, field, reason) of the bars that hold a case; reason is impossible, spike or hangs.

    Impossible: close <= 0, high below open or close, volume < 0. Spike: one or two bars above (close: or below) both
    neighbours by more than the fences, a context of fewer than ``least_changes`` having the series' range; neighbours are the
    nearest positive readings, so nulls and impossible readings are stepped over, and the first and last readings of a series are none. Hangs: equal to the bar before, within a run of at
    least ``run`` equal bars of a series that otherwise moves; a null reading ends a run. A bar delivered several times with
    different readings counts with the one of the greatest (load_id, row_id). Rows without trade_date have no place in the
    order and are no case. A null source or ticker is a series of its own. An empty table gives no rows.
    """
    names = list(rules.fences)
    bars = _bars(df, rules)
    over = "PARTITION BY source, ticker ORDER BY trade_date"
    order = Window.partitionBy("source", "ticker").orderBy("trade_date")
    n = rules.run - 1
    logs = bars.select("*", *(F.when(F.col(c) > 0, F.ln(c)).alias(f"x_{c}") for c in names))
    near = logs.select(
        *logs.columns,
        *(_ignoring(f, f"x_{c}", k, over).alias(f"{f}{k}_{c}") for c in names for f in ("lag", "lead") for k in (1, 2)),
        *(F.coalesce(F.col(c) == F.lag(c).over(order), F.lit(False)).cast("int").alias(f"same_{c}") for c in names),
    )
    full = near.select("*", *((F.sum(f"same_{c}").over(order.rowsBetween(1 - n, 0)) == n).alias(f"full_{c}") for c in names))
    runs = full.select("*", *(((F.col(f"same_{c}") == 1) & F.max(f"full_{c}").over(order.rowsBetween(0, n - 1))).alias(f"hung_{c}") for c in names))

    def margin(c: str, down: bool) -> Column:
        """By how much the reading, or the pair of bars it is in, stands out from the readings before and after."""
        s = -1 if down else 1
        x, l1, l2, r1, r2 = (s * F.col(f"{k}_{c}") for k in ("x", "lag1", "lag2", "lead1", "lead2"))
        out = lambda inside, before, after: F.when(before.isNotNull() & after.isNotNull(), inside - F.greatest(before, after))
        pair_first = F.when(r1.isNotNull(), out(F.least(x, r1), l1, r2))
        pair_second = F.when(l1.isNotNull(), out(F.least(x, l1), l2, r1))
        return F.when(F.col(f"x_{c}").isNotNull(), F.greatest(out(x, l1, r1), pair_first, pair_second))

    def impossible(c: str) -> Column:
        if c == "close":
            return F.col("close") <= 0
        if c == "high":
            return (F.col("high") < F.col("open")) | (F.col("high") < F.col("close"))
        return F.col(c) < 0

    def candidate(c: str, i: int) -> Column:
        """What may be a case of the field, before it is held against the fences; null if nothing is."""
        out, bad, hung = F.col(f"out_{c}"), F.col(f"bad_{c}"), F.col(f"hung_{c}")
        return F.when(out.isNotNull() | bad | hung, F.struct("trade_date", F.lit(i).alias("i"), bad.alias("impossible"), out.alias("margin"), hung.alias("hung")))

    # each expression once: a step for the margins, one for those beyond the least fence, one for the candidates
    least = {c: max(f.change, f.series * rules.least_range) for c, f in rules.fences.items()}
    margins = runs.select(
        "source", "ticker", "trade_date", *(f"same_{c}" for c in names), *((F.col(f"x_{c}") - F.col(f"lag1_{c}")).alias(f"change_{c}") for c in names),
        *((F.greatest(margin(c, False), margin(c, True)) if rules.fences[c].down else margin(c, False)).alias(f"all_{c}") for c in names),
        *(F.coalesce(impossible(c), F.lit(False)).alias(f"bad_{c}") for c in names), *(F.coalesce(F.col(f"hung_{c}"), F.lit(False)).alias(f"hung_{c}") for c in names),
    )
    beyond = margins.select("*", *(F.when(F.col(f"all_{c}") > least[c], F.col(f"all_{c}")).alias(f"out_{c}") for c in names))
    any_case = reduce(lambda a, b: a | b, (F.col(f"out_{c}").isNotNull() | F.col(f"bad_{c}") | F.col(f"hung_{c}") for c in names))
    # contexts, then series: both groups lie within the partitions of the sort, so nothing is shuffled again; a series' lists
    # have at most a row a date. A month is a number from 0 on, a weekday a negative one
    month, weekday = F.year("trade_date") * 12 + F.month("trade_date"), -1 - F.weekday("trade_date")
    may = F.when(any_case, F.array(*(candidate(c, i) for i, c in enumerate(names))))
    none = F.lit(None).cast("array<struct<trade_date: date, i: int, impossible: boolean, margin: double, hung: boolean>>")
    kept = beyond.select(
        "source", "ticker", *(f"change_{c}" for c in names), *(f"same_{c}" for c in names),
        F.explode(F.array(F.struct(month.alias("context"), may.alias("may")), F.struct(weekday.alias("context"), none.alias("may")))).alias("in"),
    ).select("*", "in.context", "in.may")
    per = lambda *f: [g(c) for c in names for g in f]
    contexts = kept.groupBy("source", "ticker", "context").agg(
        F.array_compact(F.flatten(F.collect_list("may"))).alias("may"), F.count(F.lit(1)).alias("bars"),
        *per(lambda c: F.kll_sketch_agg_double(f"change_{c}", F.lit(rules.sketch)).alias(f"sketch_{c}"), lambda c: F.count(f"change_{c}").alias(f"n_{c}"), lambda c: F.sum(f"same_{c}").alias(f"same_{c}")),
    )
    width = lambda s: F.greatest(F.kll_sketch_get_quantile_double(s, F.lit(0.75)) - F.kll_sketch_get_quantile_double(s, F.lit(0.25)), F.lit(rules.least_range))
    recurring = F.col("context") < 0
    sketch = lambda c: F.when(recurring & (F.col(f"n_{c}") > 0), F.col(f"sketch_{c}"))
    whole = lambda c: F.sum(F.when(recurring, F.col(c)))
    ranges = F.array(*(F.when(F.col(f"n_{c}") >= rules.least_changes, width(F.col(f"sketch_{c}"))) for c in names))
    series = contexts.groupBy("source", "ticker").agg(
        F.collect_list(F.when(F.size("may") > 0, F.struct("may", ranges.alias("ranges")))).alias("months"),
        F.map_from_entries(F.collect_list(F.when(recurring, F.struct("context", ranges.alias("ranges"))))).alias("weekdays"),
        *per(lambda c: F.kll_merge_agg_double(sketch(c), F.lit(rules.sketch)).alias(f"sketch_{c}"), lambda c: whole(f"n_{c}").alias(f"n_{c}"), lambda c: (whole(f"same_{c}") / whole("bars")).alias(f"still_{c}")),
    )
    judged = (
        series.where(F.size("months") > 0)
        .select(
            "source", "ticker", "weekdays", F.explode("months").alias("m"),
            F.array(*(F.when(F.col(f"n_{c}") > 0, width(F.col(f"sketch_{c}"))) for c in names)).alias("ranges"), F.array(*(F.col(f"still_{c}") for c in names)).alias("stills"),
        )
        .select("source", "ticker", "weekdays", "ranges", "stills", F.col("m.ranges").alias("month_ranges"), F.explode("m.may").alias("c"))
        .select(
            "source", "ticker", "c.*", F.get("ranges", F.col("c.i")).alias("series_range"), F.get("stills", F.col("c.i")).alias("still"), F.get("month_ranges", F.col("c.i")).alias("month_range"),
            F.get(F.element_at("weekdays", -1 - F.weekday("c.trade_date")), F.col("c.i")).alias("weekday_range"),
        )
    )
    fixed = lambda k: F.get(F.array(*(F.lit(float(getattr(rules.fences[c], k))) for c in names)), F.col("i"))
    beyond_its = lambda k: F.col("margin") > fixed(k) * F.coalesce(f"{k}_range", "series_range")
    spike = beyond_its("series") & beyond_its("month") & beyond_its("weekday")
    reasons = F.array_compact(F.array(F.when(F.col("impossible"), F.lit("impossible")), F.when(spike, F.lit("spike")), F.when(F.col("hung") & (F.col("still") < rules.still), F.lit("hangs"))))
    return judged.select("source", "ticker", "trade_date", F.get(F.array(*map(F.lit, names)), F.col("i")).alias("field"), F.explode(reasons).alias("reason"))


def spike_rows(df: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """(row_id, field) of every row of a bar with a case that holds a reading of the field; each once. See spike_cases."""
    cases = spike_cases(df, rules).select("source", "ticker", "trade_date", "field").distinct().alias("c")
    rows = df.select("row_id", "source", "ticker", "trade_date", *(F.col(c).isNotNull().alias(f"has_{c}") for c in rules.fences)).alias("r")
    held = reduce(lambda a, b: a | b, ((F.col("field") == c) & F.col(f"has_{c}") for c in rules.fences))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("source", "ticker")] + [F.col("r.trade_date") == F.col("c.trade_date")]
    return rows.join(cases, on).where(held).select("row_id", "field")
