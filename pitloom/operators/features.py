"""Feature builders over a panel; each takes and gives a DataFrame and keeps its rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.functions import windows as W
from pitloom.functions.safe import clip, ratio
from pitloom.operators.ranks import percentile_ranks


@dataclass(frozen=True)
class FeatureSettings:
    short: int = 5
    medium: int = 20
    long: int = 60
    rsi: int = 14
    year: int = 120


def add_price_features(panel: DataFrame, s: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Log returns, volatilities and their ratio, momentum and relative strength; from rows up to the bar's own only."""
    w = W.by_date("ticker")
    x = F.col("adj_close")
    first = panel.select("*", W.log_return(x, w).alias("px_ret_1d"), (x - F.lag(x).over(w)).alias("_change"))
    r = F.col("px_ret_1d")
    vol = first.select(
        "*",
        W.log_return(x, w, s.short).alias(f"px_ret_{s.short}d"),
        W.log_return(x, w, s.medium).alias(f"px_ret_{s.medium}d"),
        W.volatility(r, w, s.short).alias(f"px_vol_{s.short}d"),
        W.volatility(r, w, s.medium).alias(f"px_vol_{s.medium}d"),
        W.volatility(r, w, s.long).alias(f"px_vol_{s.long}d"),
        W.momentum(x, w, s.long).alias(f"px_mom_{s.long}d"),
    )
    whole = W.wilder_rsi(vol, ["ticker"], "_change", f"px_rsi_{s.rsi}", s.rsi)
    return whole.withColumn("px_vol_ratio", ratio(F.col(f"px_vol_{s.short}d"), F.col(f"px_vol_{s.medium}d"))).drop("_change")


def add_market_features(panel: DataFrame, s: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Beta and correlation with the benchmark's return; needs px_ret_1d. The benchmark has one row a date."""
    market = panel.where("is_benchmark").groupBy("trade_date").agg(F.max("px_ret_1d").alias("_market"))
    w = W.by_date("ticker")
    x, m = F.col("px_ret_1d"), F.col("_market")
    both = x.isNotNull() & m.isNotNull()
    joined = panel.join(market, "trade_date", "left").select(*panel.columns, F.when(both, x).alias("_x"), F.when(both, m).alias("_m"))
    last = W.last_rows(w, s.long)
    # each moment once, over one frame
    moments = joined.select(
        "*", F.count("_x").over(last).alias("_n"), F.covar_samp("_x", "_m").over(last).alias("_xm"), F.var_samp("_x").over(last).alias("_xx"), F.var_samp("_m").over(last).alias("_mm")
    )
    full = F.col("_n") == s.long
    return moments.select(
        *panel.columns,
        F.when(full, ratio(F.col("_xm"), F.col("_mm"))).alias(f"mkt_beta_{s.long}d"),
        F.when(full, clip(ratio(F.col("_xm"), F.sqrt(F.col("_xx")) * F.sqrt(F.col("_mm"))), -1.0, 1.0)).alias(f"mkt_corr_{s.long}d"),
    )


def add_cross_sectional_features(panel: DataFrame, s: FeatureSettings = FeatureSettings(), small: bool = False) -> DataFrame:
    """Percentile ranks of the medium return on each date, among all tickers and among those of the sector.

    Returns are ranked to six decimals, so that those that differ by the order of a sum are ties. ``small``: see
    ranks.percentile_ranks; groups of a sector are parts of those of a date, so both are ranked in one partitioning.
    """
    one = panel.withColumn("_return", F.round(f"px_ret_{s.medium}d", 6))
    for keys, name in ((["trade_date"], "market"), (["trade_date", "sector"], "sector")):
        one = percentile_ranks(one, keys, "_return", f"cs_{name}_rank_{s.medium}d", small=small)
    return one.drop("_return")


def add_year_changes(wide: DataFrame, date: str, columns: list[str], rows: int, scale: float = 100.0, keys: list[str] = []) -> DataFrame:
    """(date, columns..., <column>_yoy): change in percent over so many rows of a table of one row a date (and key), not filled."""
    w = W.by_date(*keys, date=date)
    return wide.select("*", *(((ratio(F.col(c), F.lag(c, rows).over(w)) - 1) * scale).alias(f"{c}_yoy") for c in columns))


def add_fundamental_ratios(wide: DataFrame, s: FeatureSettings = FeatureSettings(), sales: list[str] = ["salesnet"], profit: str = "profitaftertax", equity: str = "ownersfunds", outlay: str = "plantoutlay", staff: str = "staffcount") -> DataFrame:
    """Margin, return on equity, outlay share, sales per head and growth of sales over ``year`` rows, within [-1, 5].

    ``sales`` are alternatives in order of preference. Growth from 0 is the bound, as an infinite one would be.
    """
    w = W.by_date("ticker")
    have = lambda c: F.col(c) if c in wide.columns else F.lit(None).cast("double")
    x = wide.withColumn("_sales", F.coalesce(*(have(c) for c in sales)))
    before = F.lag("_sales", s.year).over(w)
    growth = F.when(before == 0, F.when(F.col("_sales") > 0, 5.0).when(F.col("_sales") < 0, -1.0)).otherwise(clip(ratio(F.col("_sales"), before) - 1, -1.0, 5.0))
    return x.select(
        "*", ratio(have(profit), F.col("_sales")).alias("fd_margin"), ratio(have(profit), have(equity)).alias("fd_roe"),
        ratio(have(outlay), F.col("_sales")).alias("fd_outlay"), ratio(F.col("_sales"), have(staff)).alias("fd_sales_per_head"), growth.alias("fd_growth"),
    ).drop("_sales")


def add_macro_features(wide: DataFrame, passed: list[str], changed: list[str], rows: int = 252, date: str = "trade_date") -> DataFrame:
    """(date, passed..., <changed>_yoy...): levels of some series as they are, of others the change in percent over so many rows.

    ``wide`` has a column a series; one that it lacks is null.
    """
    have = [F.col(c) if c in wide.columns else F.lit(None).cast("double").alias(c) for c in dict.fromkeys([*passed, *changed])]
    return add_year_changes(wide.select(date, *have), date, changed, rows).select(date, *passed, *(f"{c}_yoy" for c in changed))


def assemble(panel: DataFrame, macro: DataFrame | None = None, fundamentals: DataFrame | None = None, s: FeatureSettings = FeatureSettings(), small: bool = False) -> DataFrame:
    """All builders in the order that shuffles least: ticker, ticker, then dated and keyed tables, the dates' ranks last.

    ``small`` tells that no date has more tickers than a task can rank.
    """
    out = panel.transform(add_price_features, s).transform(add_market_features, s)
    if fundamentals is not None:
        out = out.join(fundamentals, ["ticker", "trade_date"], "left")
    if macro is not None:
        out = out.join(macro, "trade_date", "left")
    return out.transform(add_cross_sectional_features, s, small)
