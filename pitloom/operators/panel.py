"""Panels of daily bars: the row in force, labels, validity joins, wide forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitloom.functions.windows import by_date, log_return

BAR = ["open", "high", "low", "close", "adj_close", "volume", "sector", "is_benchmark"]


def in_force(df: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """One row per key: the one of the greatest ``version``, of equal ones the greatest by ``columns`` in their order."""
    last = F.max(F.struct(version, *columns)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in columns))


def bars(prices: DataFrame) -> DataFrame:
    return in_force(prices, ["ticker", "trade_date"], "loaded_at", BAR)


def returns_and_labels(panel: DataFrame) -> DataFrame:
    """Adds log_return (natural), the next bar's date, prices and return, and the three-valued label next_return_positive.

    The first bar of a ticker has no return, the last no label.
    """
    w = by_date("ticker")
    one = panel.withColumn("log_return", log_return(F.col("adj_close"), w))
    lead = lambda c: F.lead(c).over(w)
    return one.select(
        "*", lead("trade_date").alias("next_trade_date"), lead("close").alias("next_close"), lead("adj_close").alias("next_adj_close"),
        lead("log_return").alias("next_log_return"), (lead("log_return") > 0).alias("next_return_positive"),
    )


def interval_join(panel: DataFrame, dimension: DataFrame, key: str, at: str, begin: str, end: str, attributes: list[str]) -> DataFrame:
    """Rows with the attributes of the dimension row valid at ``at``, both ends included; an open end is null.

    An equi-join on the key with the interval as a further condition: the planner broadcasts the dimension only if it is
    within the session's threshold. Rows outside all intervals are dropped, overlapping intervals repeat rows.
    """
    d = dimension.select(F.col(key).alias("_key"), F.col(begin).alias("_begin"), F.col(end).alias("_end"), *(F.col(a).alias(f"_a_{a}") for a in attributes))
    on = (panel[key] == d["_key"]) & (panel[at] >= d["_begin"]) & (d["_end"].isNull() | (panel[at] <= d["_end"]))
    kept = [c for c in panel.columns if c not in attributes]
    return panel.join(d, on).select(*(panel[c] for c in kept), *(d[f"_a_{a}"].alias(a) for a in attributes))


def latest_by(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Per group the greatest ``order`` and, of each value column, the last value that is not null."""
    return df.groupBy(*keys).agg(F.max(order).alias(f"max_{order}"), *(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values))


def widen(df: DataFrame, keys: list[str], name: Column, value: Column, names: list[str], prefix: str = "") -> DataFrame:
    """One column for each of ``names``, the greatest value; names that are not listed are left out."""
    out = df.select(*keys, name.alias("_name"), value.alias("_value")).groupBy(*keys).pivot("_name", names).agg(F.max("_value"))
    return out.select(*keys, *(F.col(f"`{n}`").alias(f"{prefix}{n.lower()}") for n in names))


def missing_from(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` lacks: an anti join."""
    return df.select(*keys).distinct().join(other.select(*keys), keys, "left_anti")


def kept_columns(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns, in their own order; helper columns go, allowed ones that are missing are left out."""
    names = set(allowed)
    return df.select(*(c for c in df.columns if c in names))


def date_slice(df: DataFrame, date: str, first: str | None = None, last: str | None = None, tickers: list[str] | None = None) -> DataFrame:
    """Rows from ``first`` to ``last``, both included (None: open), perhaps of some tickers only; all of it reaches the scan."""
    if first is not None:
        df = df.where(F.col(date) >= F.lit(first).cast("date"))
    if last is not None:
        df = df.where(F.col(date) <= F.lit(last).cast("date"))
    return df if tickers is None else df.where(F.col("ticker").isin(tickers))


def common_dates(a: DataFrame, b: DataFrame, date: str = "trade_date") -> DataFrame:
    """Rows of ``a`` on dates that ``b`` has too."""
    return a.join(b.select(date).distinct(), date, "left_semi")


def exact_sample(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer), always the same: those of the least hash of key and seed. ``n_total``: how many there are."""
    mark = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.withColumn("_mark", mark).orderBy("_mark").limit(n).drop("_mark").withColumn("n_total", total)
