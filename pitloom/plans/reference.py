
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitloom.functions.hashing import content_hash, fixed
from pitloom.functions.safe import number
from pitloom.functions.windows import by_date, log_return, volatility
from pitloom.operators import backtest as B
from pitloom.operators import drift as D
from pitloom.operators import features as X
from pitloom.operators import ingest as I
from pitloom.operators import known as K
from pitloom.operators import panel as P
from pitloom.operators import quality as Q
from pitloom.operators.ranks import all_small
from pitloom.plans import general
from pitloom.session import cut, read, shared_folder
from pitloom.sources import sinks
from pitloom.sources.readers import rows_of
from pitloom.sources.snapshots import SnapshotStore, retained

#: The registry of the series that have a column of their own: one a series, null where the data lack it. The long form,
#: macro_asof_daily, has every series, and so has mc_yoy_by_series.
SERIES = ["PORTCALLS000000", "HOUSESTART000001", "CREDITGAP000002", "MILLOUT000003", "TRUCKORD000004", "RATEPATH000005", "MILLOUT000006", "CORECPI000007", "POTOUT000000"]
#: Series whose level is a feature, and those whose yearly change is.
PASSED = ["macro_ratepath000005", "macro_creditgap000002", "macro_portcalls000000", "macro_millout000003"]
CHANGED = ["macro_corecpi000007", "macro_housestart000001"]
TAGS = ["OwnersFunds", "PlantOutlay", "ProfitAfterTax", "SalesNet", "StaffCount"]
FOLDS = B.FoldSettings(train_months=3, test_months=1, step_months=1, gap_days=6, least_train=30, least_test=10)
FEATURES = X.FeatureSettings()
MODEL = ["px_ret_1d", "px_ret_5d", "px_ret_20d", "px_vol_20d", "px_rsi_14", "cs_market_rank_20d"]
YEAR = 252


def _r(*names: str, places: int = 6) -> list[Column]:
    return [F.round(n, places).alias(n) for n in names]


def _panel(spark: SparkSession, base: str) -> DataFrame:
    return P.bars(read(spark, base, "fct_prices_daily"))


def bars_in_force(spark: SparkSession, base: str) -> DataFrame:
    return _panel(spark, base)


def returns_labels(spark: SparkSession, base: str) -> DataFrame:
    out = P.returns_and_labels(_panel(spark, base))
    return out.select("ticker", "trade_date", *_r("log_return"), "next_trade_date", "next_close", "next_adj_close", *_r("next_log_return"), "next_return_positive")


def returns_interval_join(spark: SparkSession, base: str) -> DataFrame:
    dim = general.p5_versions(spark, base)
    out = P.interval_join(P.returns_and_labels(_panel(spark, base)), dim, "ticker", "trade_date", "valid_from", "valid_to", ["sector", "is_benchmark"])
    return out.select("ticker", "trade_date", "close", *_r("log_return"), "sector", "is_benchmark")


# --- macro ---------------------------------------------------------------------------------------------------------------


def _kind(column: str = "series_id") -> Column:
    return F.regexp_replace(column, "[0-9]+$", "")


def macro_vintage_override(spark: SparkSession, base: str) -> DataFrame:
    """Series of the kind RATEPATH are taken as never revised."""
    s = read(spark, base, "stg_macro_series")
    return I.effective_vintage(s, _kind() == "RATEPATH").groupBy("series_id", "vintage_date").agg(F.count(F.lit(1)).alias("n"))


def macro_vintages_latest(spark: SparkSession, base: str) -> DataFrame:
    return P.latest_by(read(spark, base, "stg_macro_series"), ["series_id", "vintage_date"], "observation_date", ["value"])


def _macro_days(spark: SparkSession, base: str, series: list[str] | None = None) -> DataFrame:
    """Every series (or each of the given ones) on every weekday from its first to its last vintage, with what was known then, null if nothing."""
    s = read(spark, base, "stg_macro_series")
    s = s if series is None else rows_of(s, "series_id", series)
    spans = s.groupBy("series_id").agg(F.min("vintage_date").alias("a"), F.max("vintage_date").alias("b"))
    days = spans.select("series_id", F.explode(F.filter(F.sequence("a", "b"), lambda d: F.weekday(d) < 5)).alias("trade_date"))
    return K.as_known(days, K.vintage_changes(s).withColumnRenamed("series", "series_id"), ["series_id"], "trade_date", "on", ["vintage", "observed", "value"])


def _macro_daily(spark: SparkSession, base: str) -> DataFrame:
    """As _macro_days; nothing known gives no row."""
    return _macro_days(spark, base).where("known_vintage IS NOT NULL").select("trade_date", "series_id", F.col("known_vintage").alias("vintage_date"), F.col("known_observed").alias("observation_date"), F.col("known_value").alias("value"))


def macro_asof_daily(spark: SparkSession, base: str) -> DataFrame:
    return _macro_daily(spark, base)


def _macro_wide(spark: SparkSession, base: str) -> DataFrame:
    listed = _macro_days(spark, base, SERIES).where("known_vintage IS NOT NULL")
    return P.widen(listed, ["trade_date"], F.col("series_id"), F.col("known_value"), SERIES, "macro_")


def macro_pivot_wide(spark: SparkSession, base: str) -> DataFrame:
    return _macro_wide(spark, base)


def _macro_features(spark: SparkSession, base: str) -> DataFrame:
    return X.add_macro_features(_macro_wide(spark, base), PASSED, CHANGED, YEAR)


def mc_yoy(spark: SparkSession, base: str) -> DataFrame:
    return _macro_features(spark, base).select("trade_date", *PASSED, *_r(*(f"{c}_yoy" for c in CHANGED)))


def _macro_by_series(spark: SparkSession, base: str) -> DataFrame:
    """(series_id, trade_date, value, value_yoy): each series by itself, with its change in percent over 252 of its weekdays."""
    days = _macro_days(spark, base).select("series_id", "trade_date", F.col("known_value").alias("value"))
    return X.add_year_changes(days, "trade_date", ["value"], YEAR, keys=["series_id"])


def mc_yoy_by_series(spark: SparkSession, base: str) -> DataFrame:
    return _macro_by_series(spark, base).select("series_id", "trade_date", "value", *_r("value_yoy"))


def _intervals(spark: SparkSession, base: str) -> DataFrame:
    s = read(spark, base, "stg_macro_series").distinct()
    w = by_date("series_id", "observation_date", date="vintage_date")
    end = F.coalesce(F.date_sub(F.lead("vintage_date").over(w), 1), F.lit("9999-12-31").cast("date"))
    return s.select("series_id", "observation_date", F.col("vintage_date").alias("realtime_start"), end.alias("realtime_end"), "value")


def vintage_reconstruct(spark: SparkSession, base: str) -> DataFrame:
    return I.vintages_from_intervals(_intervals(spark, base))


def macro_latest_mode(spark: SparkSession, base: str) -> DataFrame:
    s = read(spark, base, "stg_macro_series")
    last = s.groupBy("series_id", "observation_date").agg(F.max(F.struct("vintage_date", "value")).alias("l")).select("series_id", "observation_date", F.col("l.value").alias("value"))
    return I.latest_only(last).select("series_id", "observation_date", "value", "vintage_date")


# --- facts ---------------------------------------------------------------------------------------------------------------


def facts_filter_curated(spark: SparkSession, base: str) -> DataFrame:
    facts = I.curated(read(spark, base, "stg_sec_facts"), I.tag_table(spark, ["xg-core:SalesNet", "xg-core:ProfitAfterTax", "xg-core:OwnersFunds", "xg-core:SalesNet"]))
    return facts.where(F.col("form").isin("10-K", "10-Q") & (F.col("period_end") <= F.col("filed")) & F.col("value").isNotNull()).select("ticker", "tag", "filed", "period_end", "value")


def facts_latest_in_filing(spark: SparkSession, base: str) -> DataFrame:
    return K.filing_changes(read(spark, base, "stg_sec_facts"))


def _facts_daily(spark: SparkSession, base: str) -> DataFrame:
    """Each tag of each ticker on each of its trade dates, null before the first filing."""
    days = _panel(spark, base).select("ticker", "trade_date", F.lit("xg-core").alias("namespace"), F.explode(F.array(*map(F.lit, TAGS))).alias("tag"))
    return K.as_known(days, K.filing_changes(read(spark, base, "stg_sec_facts")), ["ticker", "namespace", "tag"], "trade_date", "filed", ["value", "filed", "period_end"])


def facts_pit_asof(spark: SparkSession, base: str) -> DataFrame:
    return _facts_daily(spark, base).select("trade_date", "ticker", "namespace", "tag", F.col("known_value").alias("value"), F.col("known_filed").alias("filed_used"), F.col("known_period_end").alias("period_end_used"))


def _facts_wide(spark: SparkSession, base: str) -> DataFrame:
    return P.widen(_facts_daily(spark, base).where("known_value IS NOT NULL"), ["ticker", "trade_date"], F.col("tag"), F.col("known_value"), TAGS)


def facts_pivot_first(spark: SparkSession, base: str) -> DataFrame:
    return _facts_wide(spark, base)


def _fundamentals(spark: SparkSession, base: str) -> DataFrame:
    return X.add_fundamental_ratios(_facts_wide(spark, base)).select("ticker", "trade_date", "fd_margin", "fd_roe", "fd_outlay", "fd_sales_per_head", "fd_growth")


def fd_ratios(spark: SparkSession, base: str) -> DataFrame:
    return _fundamentals(spark, base).drop("fd_growth")


def fd_growth(spark: SparkSession, base: str) -> DataFrame:
    return _fundamentals(spark, base).select("ticker", "trade_date", *_r("fd_growth"))


# --- features ------------------------------------------------------------------------------------------------------------


def px_features(spark: SparkSession, base: str) -> DataFrame:
    out = X.add_price_features(_panel(spark, base))
    return out.select("ticker", "trade_date", *_r("px_ret_1d", "px_ret_5d", "px_ret_20d", "px_vol_5d", "px_vol_20d", "px_vol_60d", "px_vol_ratio", "px_mom_60d"), *_r("px_rsi_14", places=4))


def _small(spark: SparkSession, base: str) -> bool:
    """Whether every date's tickers can be ranked in one task: a count over one column of the table, not over the panel."""
    return all_small(read(spark, base, "fct_prices_daily"), ["trade_date"])


def cs_ranks(spark: SparkSession, base: str) -> DataFrame:
    w = by_date("ticker")
    p = _panel(spark, base).select("ticker", "trade_date", "sector", log_return(F.col("adj_close"), w, FEATURES.medium).alias("px_ret_20d"))
    return X.add_cross_sectional_features(p, small=_small(spark, base)).select("ticker", "trade_date", "cs_market_rank_20d", "cs_sector_rank_20d")


def mkt_features(spark: SparkSession, base: str) -> DataFrame:
    w = by_date("ticker")
    one = _panel(spark, base).withColumn("px_ret_1d", log_return(F.col("adj_close"), w))
    return X.add_market_features(one).select("ticker", "trade_date", *_r("mkt_beta_60d", "mkt_corr_60d"))


def _features(spark: SparkSession, base: str) -> DataFrame:
    labelled = P.returns_and_labels(_panel(spark, base)).drop("log_return", "next_trade_date", "next_close", "next_adj_close")
    macro = cut(_macro_features(spark, base))  # one row a date, of known size when the panel's join is planned
    return X.assemble(labelled, macro, _fundamentals(spark, base), small=_small(spark, base))


#: The features, in the builders' order.
PX = ["px_ret_1d", "px_ret_5d", "px_ret_20d", "px_vol_5d", "px_vol_20d", "px_vol_60d", "px_vol_ratio", "px_mom_60d"]
MKT, CS = ["mkt_beta_60d", "mkt_corr_60d"], ["cs_market_rank_20d", "cs_sector_rank_20d"]
MC, FD = [*PASSED, *(f"{c}_yoy" for c in CHANGED)], ["fd_margin", "fd_roe", "fd_outlay", "fd_sales_per_head", "fd_growth"]


def features_assembled(spark: SparkSession, base: str) -> DataFrame:
    return _features(spark, base).select("ticker", "trade_date", "sector", "is_benchmark", "next_return_positive", *_r("next_log_return", *PX, *MKT, *MC, *FD), *_r("px_rsi_14", places=4), *CS)


def features_loaded(spark: SparkSession, base: str) -> DataFrame:
    """The assembled features written as a version and read back, without the rows that have no label."""
    root = shared_folder(spark)
    built = features_assembled(spark, base)
    path = sinks.write_version(cut(built), root, "v1", [F.col(c) for c in sorted(built.columns)])
    return spark.read.parquet(path).where("next_return_positive IS NOT NULL").select("ticker", "trade_date", *PX, *CS)


# --- selection and evaluation --------------------------------------------------------------------------------------------


def _predictions(spark: SparkSession, base: str) -> DataFrame:
    """A score from the return of the last 20 bars, and the label."""
    p = P.returns_and_labels(_panel(spark, base))
    w = by_date("ticker")
    x = log_return(F.col("adj_close"), w, 20)
    scored = p.select("*", F.round(1 / (1 + F.exp(-x * 5)), 6).alias("prob"))
    return scored.select("ticker", "trade_date", "sector", "close", "prob", F.col("next_return_positive").cast("int").alias("y"), F.round(F.expm1("next_log_return"), 6).alias("next_return"))


def entry_top_n(spark: SparkSession, base: str) -> DataFrame:
    return B.top_n(_predictions(spark, base), "prob", 10).where("selected").select("ticker", "trade_date", "prob")


def entry_threshold(spark: SparkSession, base: str) -> DataFrame:
    return B.rule(B.SELECTIONS, "above")(_predictions(spark, base), "prob", 0.55).where("selected").select("ticker", "trade_date", "prob")


def _baseline_rows(spark: SparkSession, base: str) -> DataFrame:
    w = by_date("ticker")
    p = _panel(spark, base).select("ticker", "trade_date", "sector", "is_benchmark", F.round(log_return(F.col("adj_close"), w, FEATURES.medium), 6).alias("px_ret_20d"))
    return X.add_cross_sectional_features(p, small=_small(spark, base))


def baseline_naive(spark: SparkSession, base: str) -> DataFrame:
    return B.naive(_panel(spark, base))


def baseline_momentum(spark: SparkSession, base: str) -> DataFrame:
    return B.momentum_signal(_baseline_rows(spark, base), "px_ret_20d")


def baseline_hold(spark: SparkSession, base: str) -> DataFrame:
    return B.hold(_panel(spark, base), F.col("is_benchmark"))


def baseline_top_rank(spark: SparkSession, base: str) -> DataFrame:
    return B.top_rank_signal(_baseline_rows(spark, base), "cs_market_rank_20d", 10, F.col("is_benchmark"))


def entry_above_median(spark: SparkSession, base: str) -> DataFrame:
    return B.above_median(_predictions(spark, base), "prob").where("selected").select("ticker", "trade_date", "prob")


def _weights(spark: SparkSession, base: str) -> DataFrame:
    return B.equal_weights(B.top_n(_predictions(spark, base), "prob", 10), 0.05)


def stake_equal_weight(spark: SparkSession, base: str) -> DataFrame:
    return _weights(spark, base).select("ticker", "trade_date", "weight")


def stake_odds(spark: SparkSession, base: str) -> DataFrame:
    picked = B.top_n(_predictions(spark, base), "prob", 10)
    return B.odds_weights(picked, "prob", 0.25, 0.05).where("selected").select("ticker", "trade_date", *_r("weight", places=8))


def stake_scaled(spark: SparkSession, base: str) -> DataFrame:
    w = by_date("ticker")
    r = _panel(spark, base).withColumn("r", log_return(F.col("adj_close"), w)).select("ticker", "trade_date", volatility(F.col("r"), w, 20).alias("vol"))
    picked = B.top_n(_predictions(spark, base), "prob", 10).join(r, ["ticker", "trade_date"])
    return B.scaled_weights(picked, "vol", 0.10, 0.05).where("selected").select("ticker", "trade_date", *_r("weight"))


def stake_fixed(spark: SparkSession, base: str) -> DataFrame:
    picked = B.select_by(_predictions(spark, base), "above", "prob", 0.55)
    return B.weigh_by(picked, "fixed", 0.02, 0.03).select("ticker", "trade_date", "side", "weight")


def turnover(spark: SparkSession, base: str) -> DataFrame:
    return B.plain_turnover(_weights(spark, base), []).select("trade_date", *_r("turnover"))


def limits_walk(spark: SparkSession, base: str) -> DataFrame:
    w = _weights(spark, base).where("prob IS NOT NULL").select(F.lit("momentum").alias("model"), "trade_date", "ticker", "weight", F.col("close").alias("price"))
    return B.limit_walk(w, ["model"])


def _band(spark: SparkSession, base: str) -> DataFrame:
    w = _weights(spark, base).where("prob IS NOT NULL").select(F.lit("momentum").alias("model"), "trade_date", "ticker", "weight", "next_return")
    walked = B.band_walk(w, ["model"])
    return walked.join(w.select("trade_date", "ticker", "next_return"), ["trade_date", "ticker"], "left")


def rebalance_walk(spark: SparkSession, base: str) -> DataFrame:
    return _band(spark, base).select("model", "trade_date", "ticker", *_r("weight", "traded", places=9))


def portfolio_returns(spark: SparkSession, base: str) -> DataFrame:
    return B.portfolio_returns(_band(spark, base), ["model"], cash=0.02).select("model", "trade_date", *_r("gross", "cash_ret", "cost", "net", "turnover", places=8))


def _two_models(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Predictions of two models on the folds' test rows, and the daily returns of their portfolios."""
    p = B.assign_folds(_predictions(spark, base).where("prob IS NOT NULL"), folds(spark, base)).where("part = 'test'")
    cells = F.array(F.struct(F.lit("momentum").alias("model"), F.col("prob").alias("prob")), F.struct(F.lit("reversal").alias("model"), F.round(1 - F.col("prob"), 6).alias("prob")))
    both = cut(p.select("fold_id", "trade_date", "ticker", F.col("close").alias("price"), "next_return", "y", F.explode(cells).alias("c")).select("*", "c.*").drop("c"))
    return both, B.run_portfolio(both, ["model", "fold_id"], cash=0.02)


def portfolio_by_fold(spark: SparkSession, base: str) -> DataFrame:
    return _two_models(spark, base)[1].select("model", "fold_id", "trade_date", *_r("gross", "cash_ret", "cost", "net", "turnover", places=8))


def _run(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    predictions, returns = _two_models(spark, base)
    return B.run_tables(predictions, cut(returns), ["model"])


def run_per_fold(spark: SparkSession, base: str) -> DataFrame:
    return _run(spark, base)["per_fold"].select("model", "fold_id", "n_obs", "n_days", *_r(*B.CLASSIFICATION), *_r("sharpe", "total_return", "max_drawdown", places=4))


def run_aggregate(spark: SparkSession, base: str) -> DataFrame:
    return _run(spark, base)["aggregate"].where("metric IN ('log_loss', 'brier', 'hit_rate', 'auc', 'sharpe')").select("model", "metric", "n", *_r("mean", "sd", "median", "q1", "q3", "iqr", places=4))


def run_pooled(spark: SparkSession, base: str) -> DataFrame:
    return _run(spark, base)["pooled"].select("model", "n_obs", "n_days", *_r(*B.CLASSIFICATION), *_r("sharpe", "total_return", "max_drawdown", places=4))


def run_yearly(spark: SparkSession, base: str) -> DataFrame:
    return _run(spark, base)["yearly"].select("model", "year", "n", *_r("sharpe", places=4))


def run_interval(spark: SparkSession, base: str) -> DataFrame:
    return _run(spark, base)["interval"]


def run_differences(spark: SparkSession, base: str) -> DataFrame:
    """Metrics by sector of the first and the later half of the dates' parity that differ, or that only one has."""
    m = _predictions(spark, base).where("sector IS NOT NULL").withColumn("odd", F.dayofmonth("trade_date") % 2)
    runs = [B.metric_rows(B.classification(m.where(F.col("odd") == k), ["sector"]).select("sector", *_r("brier", "auc")), ["sector"], "cls", ["brier", "auc"]) for k in (0, 1)]
    return B.metric_differences(*runs)


def best_sectors(spark: SparkSession, base: str) -> DataFrame:
    """The five sectors of the greatest area under the curve."""
    return B.best_runs(classification_metrics(spark, base), "auc", 5, ["sector"]).select("sector", "auc")


def _calendar(df: DataFrame) -> list:
    """Distinct trade dates: a calendar, not data that grows with the panel."""
    return [r[0] for r in df.select("trade_date").distinct().collect()]


def folds(spark: SparkSession, base: str) -> DataFrame:
    return B.folds(spark, _calendar(read(spark, base, "fct_prices_daily")), FOLDS)


def fold_assignment(spark: SparkSession, base: str) -> DataFrame:
    out = B.assign_folds(_panel(spark, base).select("ticker", "trade_date"), folds(spark, base))
    return out.groupBy("fold_id", "part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("trade_date").alias("n_dates"))


def time_decay_weights(spark: SparkSession, base: str) -> DataFrame:
    out = B.decay_weights(B.assign_folds(_panel(spark, base).select("ticker", "trade_date"), folds(spark, base)), 30.0)
    return out.select("fold_id", "trade_date", *_r("weight")).distinct()


def logistic_walk_forward(spark: SparkSession, base: str) -> DataFrame:
    f = _features(spark, base).select("ticker", "trade_date", F.col("next_return_positive").cast("double").alias("y"), *MODEL)
    assigned = B.assign_folds(f, folds(spark, base))
    model = B.fit(B.decay_weights(assigned, 60.0), MODEL, "y", "weight")
    return B.predict(assigned.where("part = 'test'"), model, MODEL).select("fold_id", "trade_date", "ticker", "prob", "y")


def classification_metrics(spark: SparkSession, base: str) -> DataFrame:
    return B.classification(_predictions(spark, base), ["sector"]).select("sector", "n", *_r("log_loss", "brier", "hit_rate", "auc"))


def reliability_curve(spark: SparkSession, base: str) -> DataFrame:
    return B.reliability(_predictions(spark, base)).select("bin", "n", *_r("mean_prob", "mean_truth"))


def calibration(spark: SparkSession, base: str) -> DataFrame:
    """Slope and intercept of one fit over all rows."""
    return spark.createDataFrame([B.calibration(_predictions(spark, base))], "slope double, intercept double").select(*_r("slope", "intercept"))


def _yearly(spark: SparkSession, base: str) -> DataFrame:
    p = _predictions(spark, base).where("next_return IS NOT NULL").withColumn("year", F.year("trade_date"))
    return B.trading(p, ["ticker", "year"], "next_return")


def sharpe_by_year(spark: SparkSession, base: str) -> DataFrame:
    return _yearly(spark, base).where("n > 2").select("ticker", "year", "n", *_r("sharpe", "total_return", "max_drawdown", places=5))


def skew_kurt(spark: SparkSession, base: str) -> DataFrame:
    return B.trading(_predictions(spark, base), ["ticker"], "next_return").where("n > 3").select("ticker", *_r("skew", "kurt", places=5))


def summary_median_iqr(spark: SparkSession, base: str) -> DataFrame:
    t = _yearly(spark, base).where("n > 2").select("year", *_r("sharpe", "max_drawdown", places=5))
    return B.summary(t, ["year"], ["sharpe", "max_drawdown"]).select("year", "metric", "n", *_r("mean", "sd", "median", "q1", "q3", "iqr", places=4))


def bootstrap_ci(spark: SparkSession, base: str) -> DataFrame:
    return B.bootstrap_sharpe(_predictions(spark, base).where("next_return IS NOT NULL"), ["ticker"], "next_return")


def deflated_sharpe(spark: SparkSession, base: str) -> DataFrame:
    """Of each sector's mean return, the sectors being the trials."""
    daily = _predictions(spark, base).where("next_return IS NOT NULL AND sector IS NOT NULL").groupBy("sector", "trade_date").agg(F.avg("next_return").alias("next_return"))
    return B.deflated(B.trading(daily, ["sector"], "next_return"), ["sector"]).select("sector", *_r("deflated"))


# --- monitoring ----------------------------------------------------------------------------------------------------------

REFERENCE_DAY = "2022-06-30"
#: What the SQL of psi and ks_statistic has; drift_status gives both figures for all features.
DRIFT_FEATURES = ["px_ret", "volume", "close"]
DRIFT_COLUMNS = [
    "px_ret_1d", "px_ret_5d", "px_ret_20d", "px_vol_5d", "px_vol_20d", "px_vol_60d", "px_vol_ratio", "px_mom_60d", "px_rsi_14", "mkt_beta_60d", "mkt_corr_60d",
    "cs_market_rank_20d", "cs_sector_rank_20d", "fd_margin", "fd_roe", "fd_outlay", "fd_sales_per_head", "fd_growth",
]
DRIFT_DATES = 60


def freshness(spark: SparkSession, base: str) -> DataFrame:
    marts = {n: (read(spark, base, n), c, w, f) for n, c, w, f in (("fct_prices_daily", "trade_date", 3, 7), ("fct_returns_daily", "trade_date", 3, 7), ("int_macro_daily", "trade_date", 45, 90), ("int_fundamentals_pit", "trade_date", 120, 180), ("stg_macro_series", "vintage_date", 45, 90))}
    return D.freshness(marts, F.lit(REFERENCE_DAY).cast("date"))


def _drift_long(spark: SparkSession, base: str) -> DataFrame:
    w = by_date("ticker")
    p = _panel(spark, base).select("ticker", "trade_date", F.round(log_return(F.col("adj_close"), w), 6).alias("px_ret"), "volume", "close")
    return D.long_features(D.windows(p, "trade_date", 30, 30), DRIFT_FEATURES)


def psi(spark: SparkSession, base: str) -> DataFrame:
    return D.psi(cut(D.counted(_drift_long(spark, base)))).select("feature", "n_ref", "n_cur", *_r("psi"))


def ks_statistic(spark: SparkSession, base: str) -> DataFrame:
    return D.ks(cut(D.counted(_drift_long(spark, base)))).select("feature", "n_ref", "n_cur", *_r("ks_stat"))


def _drift_whole(spark: SparkSession, base: str) -> DataFrame:
    """Every numeric column of the assembled features, and every macro series' level and yearly change, once a date; on the panel's first and last dates."""
    built = X.assemble(_panel(spark, base), None, _fundamentals(spark, base), small=_small(spark, base)).select("trade_date", "close", "volume", *_r(*DRIFT_COLUMNS))
    panel = D.long_features(D.windows(built, "trade_date", DRIFT_DATES, DRIFT_DATES), ["close", "volume", *DRIFT_COLUMNS])
    dates = D.windows(_panel(spark, base).select("trade_date").distinct(), "trade_date", DRIFT_DATES, DRIFT_DATES)
    macro = _macro_by_series(spark, base).join(dates, "trade_date")
    cells = F.array(*(F.struct(F.concat(F.lit(f"{n}:"), "series_id").alias("feature"), x.alias("x")) for n, x in (("macro", F.col("value")), ("macro_yoy", F.round("value_yoy", 6)))))
    series = macro.select("part", F.explode(cells).alias("c")).select("part", "c.*").where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')")
    return panel.unionByName(series)


def drift_status(spark: SparkSession, base: str) -> DataFrame:
    return D.drift_of(_drift_whole(spark, base)).select("feature", "n_ref", "n_cur", *_r("psi", "ks_stat", "ks_pvalue"), "status")


def drift_exact(spark: SparkSession, base: str) -> DataFrame:
    """As drift_status, of the macro series, whose samples are small enough for exact p-values."""
    dates = D.windows(read(spark, base, "fct_prices_daily").select("trade_date").distinct(), "trade_date", DRIFT_DATES, DRIFT_DATES)
    long = _macro_by_series(spark, base).join(dates, "trade_date").where("value IS NOT NULL").select("part", F.col("series_id").alias("feature"), F.col("value").alias("x"))
    return D.drift_of(long, exact_cells=10_000).select("feature", "n_ref", "n_cur", *_r("psi", "ks_stat", "ks_pvalue"), "status")


def drift_worst(spark: SparkSession, base: str) -> DataFrame:
    """The ten worst features: by status, then the greatest psi."""
    return D.worst_first(drift_status(spark, base), 10, ["feature"])


def perf_tail_mean(spark: SparkSession, base: str) -> DataFrame:
    m = _predictions(spark, base).where("y IS NOT NULL AND prob IS NOT NULL").withColumn("month", F.trunc("trade_date", "month"))
    scores = B.classification(m, ["sector", "month"]).select("sector", "month", *_r("log_loss", "auc", "brier"))
    return D.tail_mean(scores, ["sector"], "month", ["log_loss", "auc", "brier"], 4).select("sector", "metric", *_r("mean", places=5))


def perf_status(spark: SparkSession, base: str) -> DataFrame:
    m = _predictions(spark, base).where("y IS NOT NULL AND prob IS NOT NULL AND sector IS NOT NULL").withColumn("month", F.trunc("trade_date", "month"))
    scores = B.classification(m, ["sector", "month"]).select("sector", "month", *_r("log_loss", "auc", "brier"))
    return D.performance(scores, ["sector"], "month", 4).select("sector", "metric", *_r("mean", places=5), "status")


def perf_overall(spark: SparkSession, base: str) -> DataFrame:
    return D.overall(perf_status(spark, base), ["sector"])


# --- quality -------------------------------------------------------------------------------------------------------------


def dq_ohlc(spark: SparkSession, base: str) -> DataFrame:
    return Q.violations(read(spark, base, "stg_prices"), Q.ohlc_rules(), ["row_id"])


def dq_return_ranges(spark: SparkSession, base: str) -> DataFrame:
    return Q.violations(read(spark, base, "fct_returns_daily"), Q.between("log_return", -0.1, 0.1) | Q.between("next_log_return", -0.1, 0.1), ["ticker", "trade_date", "loaded_at"]).distinct()


def dq_label_null(spark: SparkSession, base: str) -> DataFrame:
    rules = {"label_null_iff_return_null": F.col("next_log_return").isNull() == F.col("next_return_positive").isNull(), "label_sign": (F.col("next_log_return") > 0) == F.col("next_return_positive")}
    return Q.violations(read(spark, base, "fct_returns_daily"), rules, ["ticker", "trade_date", "loaded_at"]).distinct()


def _damaged(spark: SparkSession, base: str) -> DataFrame:
    """Returns and labels, of which some are taken away and some signs turned, by the day of the month."""
    day = F.dayofmonth("trade_date")
    label = F.when(day == 13, F.lit(None)).when(day == 17, ~F.col("next_return_positive")).otherwise(F.col("next_return_positive"))
    return P.returns_and_labels(_panel(spark, base)).withColumn("next_return_positive", label).withColumn("log_return", F.when(day != 15, F.col("log_return")))


def dq_label_damaged(spark: SparkSession, base: str) -> DataFrame:
    rules = {"label_null_iff_return_null": F.col("next_log_return").isNull() == F.col("next_return_positive").isNull(), "label_sign": (F.col("next_log_return") > 0) == F.col("next_return_positive")}
    return Q.violations(_damaged(spark, base), rules, ["ticker", "trade_date"])


def dq_failure_cases(spark: SparkSession, base: str) -> DataFrame:
    """Of each rule on the day's order how many rows break it, and ten of them."""
    bad = Q.violations(read(spark, base, "stg_prices"), Q.ohlc_rules(), ["source", "ticker", "trade_date"])
    return Q.first_failures(bad, ["source", "ticker", "trade_date"], 10).select("rule", "n_rows", F.array_join("examples", ",").alias("examples"))


def prices_sliced(spark: SparkSession, base: str) -> DataFrame:
    """Bars of three quarters on dates that have a macro row, without helper columns."""
    p = P.date_slice(read(spark, base, "fct_prices_daily"), "trade_date", "2021-04-01", "2021-12-31")
    return P.kept_columns(P.common_dates(p, read(spark, base, "int_macro_daily").where("value IS NOT NULL")), ["ticker", "trade_date", "close", "volume", "no such column"])


def dq_macro_pit(spark: SparkSession, base: str) -> DataFrame:
    rules = {"vintage_not_later": F.col("vintage_date") <= F.col("trade_date"), "observation_not_later": F.col("observation_date") <= F.col("trade_date")}
    return Q.violations(read(spark, base, "int_macro_daily"), rules, ["row_id"])


def dq_facts_pit(spark: SparkSession, base: str) -> DataFrame:
    rules = {"filed_not_later": F.col("filed_used") <= F.col("trade_date"), "period_ended": F.col("period_end_used") <= F.col("filed_used")}
    return Q.violations(read(spark, base, "int_fundamentals_pit"), rules, ["row_id"])


def dq_vintage_dup(spark: SparkSession, base: str) -> DataFrame:
    return Q.duplicates(read(spark, base, "stg_macro_series"), ["series_id", "observation_date", "vintage_date"])


def dq_benchmark_present(spark: SparkSession, base: str) -> DataFrame:
    p = read(spark, base, "fct_prices_daily")
    return P.missing_from(p, p.where("is_benchmark"), ["trade_date"])


def dq_pit_boundaries(spark: SparkSession, base: str) -> DataFrame:
    """Tickers whose returns are null other than on the first bar, or whose labels are null other than on the last."""
    return _boundaries(P.returns_and_labels(_panel(spark, base)))


def dq_pit_damaged(spark: SparkSession, base: str) -> DataFrame:
    return _boundaries(_damaged(spark, base))


def _boundaries(p: DataFrame) -> DataFrame:
    n = p.groupBy("ticker").agg(F.count(F.when(F.col("log_return").isNull(), 1)).alias("null_returns"), F.count(F.when(F.col("next_return_positive").isNull(), 1)).alias("null_labels"))
    return n.where("null_returns <> 1 OR null_labels <> 1")


TICKER = "^[A-Z][A-Z0-9]{0,9}$"


def _like(column: str, pattern: str) -> dict[str, Column]:
    return {f"matches:{column}": F.col(column).rlike(pattern)}


def contracts() -> list[Q.Contract]:
    """What every layer's table must hold."""
    not_later = lambda a, b: {f"not_later:{a}": F.col(a) <= F.col(b)}
    of = lambda text: dict(c.split(":") for c in text.split())
    prices = of("ticker:string trade_date:date open:double high:double low:double close:double adj_close:double volume:bigint loaded_at:timestamp_ntz")
    series, facts = of("series_id:string observation_date:date vintage_date:date value:double"), of("ticker:string namespace:string tag:string value:double")
    filed = of("cik:bigint unit:string period_start:date period_end:date filed:date form:string fiscal_year:int fiscal_period:string frame:string")
    following = of("next_trade_date:date next_close:double next_adj_close:double next_log_return:double next_return_positive:boolean sector:string is_benchmark:boolean")
    labelled = {c: t for c, t in prices.items() if c not in ("open", "high", "low")} | of("log_return:double") | following
    columns = {
        "stg_prices": prices | of("row_id:bigint source:string load_id:bigint"), "fct_prices_daily": prices | of("sector:string is_benchmark:boolean"), "fct_returns_daily": labelled,
        "stg_macro_series": series, "int_macro_daily": series | of("row_id:bigint trade_date:date"), "stg_sec_facts": facts | filed,
        "int_fundamentals_pit": facts | of("row_id:bigint trade_date:date filed_used:date period_end_used:date"),
        "ticker_metadata": of("snapshot_date:date delivered_at:timestamp_ntz ticker:string sector:string is_benchmark:boolean valid_from:date valid_to:date"),
        "manifest": of("manifest_no:bigint source:string ticker:string latest_hash:string path:string written_at:timestamp_ntz row_count:bigint first_date:date last_date:date"),
        "drift_features": of("report_id:bigint source:string generated_at:timestamp_ntz feature:string status:string psi:string ks_pvalue:double n_ref:int n_cur:int reason:string"),
    }
    held = lambda name, rules, unique=(): Q.Contract(name, columns[name], rules, unique, strict=True)
    return [
        held("stg_prices", Q.not_null("open", "low", "adj_close", "volume", "close") | Q.ohlc_rules() | _like("ticker", TICKER), ("source", "ticker", "trade_date")),
        held("fct_prices_daily", Q.not_null("ticker", "trade_date", "close", "volume") | Q.ohlc_rules(), ("ticker", "trade_date")),
        held("fct_returns_daily", Q.not_null("ticker", "trade_date", "sector") | Q.between("log_return", -1, 1) | Q.between("next_log_return", -1, 1) | not_later("trade_date", "next_trade_date"), ("ticker", "trade_date")),
        held("stg_macro_series", Q.not_null("series_id", "value"), ("series_id", "observation_date", "vintage_date")),
        held("int_macro_daily", Q.not_null("series_id", "trade_date", "vintage_date") | not_later("vintage_date", "trade_date") | not_later("observation_date", "trade_date"), ("trade_date", "series_id")),
        held("stg_sec_facts", Q.not_null("ticker", "tag", "period_end", "filed", "form", "value") | Q.between("fiscal_year", 1990, 2100) | {"length:form": F.length("form") <= 16} | not_later("period_start", "period_end") | not_later("period_end", "filed")),
        held("int_fundamentals_pit", Q.not_null("ticker", "trade_date", "tag") | not_later("filed_used", "trade_date") | not_later("period_end_used", "filed_used"), ("trade_date", "ticker", "namespace", "tag")),
        held("ticker_metadata", Q.not_null("ticker", "sector", "valid_from") | not_later("valid_from", "valid_to") | _like("ticker", TICKER), ("ticker", "snapshot_date")),
        held("manifest", Q.not_null("source", "ticker", "latest_hash", "path") | not_later("first_date", "last_date") | {"positive:row_count": F.col("row_count") > 0}, ("source", "manifest_no", "ticker")),
        held("drift_features", Q.not_null("status", "psi") | Q.accepted("status", ["PASS", "WARN", "FAIL"])),
    ]


def dq_raw_by_ticker(spark: SparkSession, base: str) -> DataFrame:
    """The raw contract for every ticker that a source delivers."""
    raw = next(c for c in contracts() if c.name == "stg_prices")
    return Q.check_groups(read(spark, base, "stg_prices"), raw, ["source", "ticker"])


def dq_first_violation(spark: SparkSession, base: str) -> DataFrame:
    return Q.first_violation(read(spark, base, "stg_prices"), ["source", "ticker"], "trade_date", Q.bar_rules())


def dq_bar_events(spark: SparkSession, base: str) -> DataFrame:
    return Q.bar_events(read(spark, base, "stg_prices"))


def dq_contract_counts(spark: SparkSession, base: str) -> DataFrame:
    out = None
    for c in contracts():
        one = Q.check(read(spark, base, c.name), c)
        out = one if out is None else out.unionByName(one)
    return out


def dq_gate(spark: SparkSession, base: str) -> DataFrame:
    return Q.gate(dq_contract_counts(spark, base))


def dq_orphans(spark: SparkSession, base: str) -> DataFrame:
    return Q.orphans(read(spark, base, "stg_prices"), "ticker", read(spark, base, "ticker_metadata"), "ticker")


# --- ingest, sources, hashes ---------------------------------------------------------------------------------------------


def ingest_normalise(spark: SparkSession, base: str) -> DataFrame:
    raw = read(spark, base, "stg_prices").withColumn("ticker", F.concat_ws(":", "source", "ticker"))
    names = {"trade_date": "date", "open": "open", "high": "high", "low": "low", "close": "close", "adj_close": "adj_close", "volume": "volume"}
    return I.normalise_bars(raw, names, F.col("ticker"), "row_id")


def missing_sentinel_parse(spark: SparkSession, base: str) -> DataFrame:
    d = read(spark, base, "drift_features")
    return d.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"), F.count(number(F.col("psi"))).alias("n_numbers"))


def json_facts_flatten(spark: SparkSession, base: str) -> DataFrame:
    """Every fact packed into a nested document of its own, and unpacked again."""
    f = read(spark, base, "stg_sec_facts")
    text = lambda c: F.col(c).cast("string")
    row = F.struct(text("period_start").alias("start"), text("period_end").alias("end"), text("value").alias("val"), text("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"), "form", text("filed").alias("filed"), "frame")
    units = F.struct(F.create_map(F.coalesce("unit", F.lit("none")), F.array(row)).alias("units"))
    doc = F.to_json(F.struct(F.create_map(F.coalesce("namespace", F.lit("none")), F.create_map(F.coalesce("tag", F.lit("none")), units)).alias("facts")))
    return I.flatten_facts(f.select("ticker", doc.alias("document")), "document", "ticker")


def json_facts_messy(spark: SparkSession, base: str) -> DataFrame:
    """As json_facts_flatten, of documents with something of another shape beside the fact on every level, and some that are none."""
    f = read(spark, base, "stg_sec_facts").select("*", F.row_number().over(Window.partitionBy("ticker", "tag").orderBy(*(c for c in ("namespace", "unit", "period_start", "period_end", "filed", "form", "value")))).alias("_k"))
    text = lambda c: F.col(c).cast("string")
    row = F.to_json(F.struct(text("period_start").alias("start"), text("period_end").alias("end"), text("value").alias("val"), text("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"), "form", text("filed").alias("filed"), "frame"))
    inside = F.concat(F.lit('[7,"x",null,[1],'), row, F.lit(',{"end":"never"}]'))
    for name, junk in (("unit", '"bad":5,"worse":{"a":1},"none at all":null'), ("units", '"label":"l","more":[1]'), ("tag", '"note":"x","list":[{"units":{}}]'), ("namespace", '"text":"t","number":3')):
        key = F.lit(name) if name == "units" else F.coalesce(name, F.lit("none"))
        inside = F.concat(F.lit("{" + junk + ',"'), key, F.lit('":'), inside, F.lit("}"))
    doc = F.concat(F.lit('{"name":"n","facts":'), inside, F.lit("}"))
    broken = F.array(doc, F.lit("no json"), F.lit('{"facts":[1,2]}'), F.lit('{"facts":"text"}'), F.lit("{}"), F.lit(None).cast("string"))
    return I.flatten_facts(f.select("ticker", F.explode(F.when(F.col("_k") == 1, broken).otherwise(F.array(doc))).alias("document")), "document", "ticker")


def snapshot_store_returns(spark: SparkSession, base: str) -> DataFrame:
    """Bars of each source and load in a store: the first half of them, then others, then the first again; what the store holds last."""
    p = read(spark, base, "stg_prices").select("source", "load_id", "ticker", "trade_date", "close", "row_id")
    store = SnapshotStore(shared_folder(spark), ("source", "load_id"), "trade_date", (F.col("row_id"), F.col("ticker"), fixed(F.col("close"), 4)))
    first = p.where("row_id % 2 = 0")
    for at, rows in enumerate((first, p, first)):
        store.write(rows, F.timestamp_seconds(F.lit(at)))
    return store.read_latest(spark).select(*p.columns)


def snapshot_hash(spark: SparkSession, base: str) -> DataFrame:
    p = read(spark, base, "stg_prices")
    return content_hash(p, ["source", "load_id"], [F.col("ticker"), F.col("trade_date"), fixed(F.col("close"), 4), fixed(F.col("high"), 4), F.col("volume")])


def snapshot_retention(spark: SparkSession, base: str) -> DataFrame:
    m = read(spark, base, "manifest").where("path IS NOT NULL")
    return retained(m, ["source", "ticker"])


def sample_exact_n(spark: SparkSession, base: str) -> DataFrame:
    return P.exact_sample(read(spark, base, "stg_prices").select("row_id", "ticker", "close"), F.col("row_id"), 1000)


QUERIES = {
    f.__name__: f
    for f in (
        bars_in_force, returns_labels, returns_interval_join, macro_vintage_override, macro_vintages_latest, macro_asof_daily, macro_pivot_wide, mc_yoy, mc_yoy_by_series, vintage_reconstruct, macro_latest_mode,
        facts_filter_curated, facts_latest_in_filing, facts_pit_asof, facts_pivot_first, fd_ratios, fd_growth, px_features, cs_ranks, mkt_features, features_assembled, features_loaded,
        entry_top_n, entry_threshold, entry_above_median, baseline_naive, baseline_momentum, baseline_hold, baseline_top_rank, stake_equal_weight, stake_odds, stake_scaled, stake_fixed, turnover, limits_walk, rebalance_walk, portfolio_returns, portfolio_by_fold, run_per_fold, run_aggregate, run_pooled, run_yearly, run_interval, run_differences, best_sectors, folds, fold_assignment, time_decay_weights, logistic_walk_forward,
        classification_metrics, reliability_curve, calibration, sharpe_by_year, skew_kurt, summary_median_iqr, bootstrap_ci, deflated_sharpe, freshness, psi, ks_statistic, drift_status, drift_exact, drift_worst, perf_tail_mean, perf_status, perf_overall,
        dq_ohlc, dq_return_ranges, dq_label_null, dq_label_damaged, dq_failure_cases, prices_sliced, dq_macro_pit, dq_facts_pit, dq_vintage_dup, dq_benchmark_present, dq_pit_boundaries, dq_pit_damaged, dq_contract_counts, dq_raw_by_ticker, dq_first_violation, dq_bar_events, dq_gate, dq_orphans,
        ingest_normalise, missing_sentinel_parse, json_facts_flatten, json_facts_messy, snapshot_hash, snapshot_store_returns, snapshot_retention, sample_exact_n,
    )
}
