"""Queries p1 to p7 over the market tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitloom.operators import grid, history, known, profile, rolling, snapshots, spikes
from pitloom.session import read, shared_folder, together

PRICES = [profile.ColumnContract("low", least=0.0, strict=True), profile.ColumnContract("volume", least=0.0)]
#: Readable psi texts: a plain decimal number with a point, perhaps with a minus sign.
DRIFT = [profile.ColumnContract("psi", least=0.0, format="-?[0-9]+[.][0-9]+")]


def _both(spark: SparkSession, base: str, of) -> DataFrame:
    prices, drift = together(
        lambda: of(read(spark, base, "stg_prices"), PRICES, "load_id", "ticker").withColumn("table_name", F.lit("stg_prices")),
        lambda: of(read(spark, base, "drift_features"), DRIFT, "report_id", None).withColumn("table_name", F.lit("drift_features")),
    )
    return prices.unionByName(drift).withColumnRenamed("load", "load_id")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    found = _both(spark, base, lambda df, contracts, load, by: profile.departures(df, contracts, "source", load, by))
    return found.select("table_name", "column_name", "load_id", "issue").distinct()


def p1_profile(spark: SparkSession, base: str) -> DataFrame:
    def one(df: DataFrame, contracts: list, load: str, by: str | None) -> DataFrame:
        return profile.load_profile(df, contracts, "source", load).withColumn("column_name", profile._name(contracts)).drop("column")

    return _both(spark, base, one).select("table_name", "column_name", "source", "load_id", "n_rows", "n_null", "n_unreadable", "n_values", "n_distinct", "least", "most")


def p1_masks(spark: SparkSession, base: str) -> DataFrame:
    out = _both(spark, base, lambda df, contracts, load, by: profile.mask_profile(df, contracts, "source", load))
    return out.select("table_name", "column_name", "source", "load_id", "mask", "n", "rare")


def p1_divergence(spark: SparkSession, base: str) -> DataFrame:
    out = _both(spark, base, lambda df, contracts, load, by: profile.mask_divergence(df, contracts, "source", load))
    return out.select("table_name", "column_name", "source", "load_id", "n_texts", "n_rare", F.round("divergence", 6).alias("divergence"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return spikes.spike_rows(read(spark, base, "stg_prices"))


def p2_reasons(spark: SparkSession, base: str) -> DataFrame:
    return spikes.spike_cases(read(spark, base, "stg_prices"))


def _volume(spark: SparkSession, base: str) -> DataFrame:
    return rolling.trailing(rolling.daily_totals(read(spark, base, "fct_prices_daily"), "ticker", "trade_date", "volume", "loaded_at"))


def _returns(spark: SparkSession, base: str) -> DataFrame:
    # the totals are of whole millionths: exact, in any order
    returns = read(spark, base, "fct_returns_daily").select("ticker", "trade_date", "loaded_at", F.round(F.col("log_return") * 1_000_000).cast("long").alias("micro"))
    return rolling.trailing(rolling.daily_totals(returns, "ticker", "trade_date", "micro", "loaded_at"))


def p3_rolling(spark: SparkSession, base: str) -> DataFrame:
    volume = _volume(spark, base).withColumn("measure", F.lit("volume")).withColumn("scale", F.lit(1.0))
    returns = _returns(spark, base).withColumn("measure", F.lit("log_return")).withColumn("scale", F.lit(1_000_000.0))
    both = volume.unionByName(returns)
    columns = [(F.col(c) / F.col("scale")).alias(c) for c in ("total_7", "total_30")]
    means = [(F.col(f"total_{n}") / F.col("scale") / n).alias(f"mean_{n}") for n in (7, 30)]
    return both.select(F.col("entity").alias("ticker"), F.col("day").alias("trade_date"), "measure", *columns, *means)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    whole = lambda n: F.date_sub("day", n - 1) >= F.col("first_day")
    volume, returns = _volume(spark, base), _returns(spark, base)
    tests = F.array_compact(
        F.array(
            F.when(whole(30) & (F.col("total_30") > 0) & (15 * F.col("total_7") >= 7 * F.col("total_30")), F.lit("volume")),
            F.when(whole(7) & (F.col("total_7") == 0), F.lit("silent")),
        )
    )
    cases = volume.select("entity", "day", F.explode(tests).alias("measure")).unionByName(
        returns.where(whole(7) & (F.col("total_7") <= -150_000)).select("entity", "day", F.lit("log_return").alias("measure"))
    )
    return cases.select(F.col("entity").alias("ticker"), F.col("day").cast("string").alias("trade_date"), "measure")


def p4_changes(spark: SparkSession, base: str) -> DataFrame:
    manifest = snapshots.snapshot_changes(read(spark, base, "manifest"), ["source"], "manifest_no", ["ticker"], {"latest_hash": F.lower("latest_hash")})
    series = snapshots.snapshot_changes(read(spark, base, "stg_macro_series"), ["series_id"], "vintage_date", ["observation_date"], {"value": F.col("value")})
    bars = snapshots.redelivered_changes(read(spark, base, "stg_prices"), ["source", "ticker", "trade_date"], "load_id", "adj_close", 0.0001)
    text = lambda c: F.col(c).cast("string")
    return (
        manifest.select(F.lit("manifest").alias("table_name"), F.col("source").alias("entity"), text("manifest_no").alias("snapshot"), F.col("ticker").alias("record"), "change", F.array_join("fields", ",").alias("fields"))
        .unionByName(series.select(F.lit("stg_macro_series").alias("table_name"), F.col("series_id").alias("entity"), text("vintage_date").alias("snapshot"), text("observation_date").alias("record"), "change", F.array_join("fields", ",").alias("fields")))
        .unionByName(bars.select(F.lit("stg_prices").alias("table_name"), F.col("source").alias("entity"), text("load_id").alias("snapshot"), F.concat_ws(" ", "ticker", text("trade_date")).alias("record"), F.lit("changed").alias("change"), F.lit("adj_close").alias("fields")))
    )


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return p4_changes(spark, base).drop("fields")


def p5_versions(spark: SparkSession, base: str, grace_days: int = 5) -> DataFrame:
    """History from the deliveries in time, in a store; late or superseding ones then replace the chains that they touch there."""
    raw = read(spark, base, "ticker_metadata").select("ticker", "snapshot_date", "delivered_at", history.plain_words(F.col("sector")).alias("sector"), "is_benchmark", "valid_from", "valid_to")
    late = F.coalesce(F.col("delivered_at") >= F.date_add("snapshot_date", grace_days), F.lit(True))
    store = history.ChainStore(spark, shared_folder(spark), buckets=16)
    store.apply(raw.where(~late), "in time")
    store.apply(raw.where(late), "late")
    return store.read()


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return p5_versions(spark, base).select("ticker", "sector", F.col("valid_from").cast("string").alias("valid_from"), F.coalesce(F.col("valid_to").cast("string"), F.lit("open")).alias("valid_to"))


def p6_grid(spark: SparkSession, base: str) -> DataFrame:
    return grid.weekday_grid(read(spark, base, "int_macro_daily"), "series_id", "trade_date", "value", "row_id").withColumnsRenamed({"series": "series_id", "day": "trade_date"})


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_grid(spark, base).where("missing").select("series_id", F.col("trade_date").cast("string").alias("trade_date"))


def p6_weeks(spark: SparkSession, base: str) -> DataFrame:
    """The same readings on a grid of weeks from Monday, each valid for ten days at most."""
    out = grid.time_grid(read(spark, base, "int_macro_daily"), "series_id", "trade_date", "value", "row_id", timedelta(days=7), timedelta(days=10), timedelta(days=4))
    return out.select(F.col("series").alias("series_id"), F.col("cell").cast("date").alias("week"), F.round("value", 6).alias("value"), "coverage", F.round("filled", 6).alias("filled"), "missing")


def _macro_known(spark: SparkSession, base: str) -> DataFrame:
    changes = known.vintage_changes(read(spark, base, "stg_macro_series"))
    events = read(spark, base, "int_macro_daily").select("row_id", "trade_date", "series_id", "vintage_date", "observation_date", "value")
    return known.as_known(events, changes.withColumnRenamed("series", "series_id"), ["series_id"], "trade_date", "on", ["vintage", "observed", "value"])


def _facts_known(spark: SparkSession, base: str) -> DataFrame:
    changes = known.filing_changes(read(spark, base, "stg_sec_facts"))
    events = read(spark, base, "int_fundamentals_pit").select("row_id", "trade_date", "ticker", "namespace", "tag", "value", "filed_used", "period_end_used")
    return known.as_known(events, changes, ["ticker", "namespace", "tag"], "trade_date", "filed", ["filed", "value", "period_end"])


def p7_known(spark: SparkSession, base: str) -> DataFrame:
    """Every row with what was known on its trade_date, and whether it holds just that."""
    macro = _macro_known(spark, base)
    facts = _facts_known(spark, base)
    agree = lambda pairs: F.expr(" AND ".join(f"({a} <=> {b})" for a, b in pairs))
    return macro.select(
        F.lit("int_macro_daily").alias("table_name"), "row_id", F.col("known_vintage").alias("known_date"), F.col("known_observed").alias("known_period"), "known_value",
        agree([("vintage_date", "known_vintage"), ("observation_date", "known_observed"), ("value", "known_value")]).alias("agrees"),
    ).unionByName(
        facts.select(
            F.lit("int_fundamentals_pit").alias("table_name"), "row_id", F.col("known_filed").alias("known_date"), F.col("known_period_end").alias("known_period"), "known_value",
            agree([("filed_used", "known_filed"), ("period_end_used", "known_period_end"), ("value", "known_value")]).alias("agrees"),
        )
    )


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return p7_known(spark, base).where(~F.col("agrees")).select("table_name", "row_id", F.coalesce(F.col("known_date").cast("string"), F.lit("none")).alias("known_date"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_profile, p1_masks, p1_divergence, p2_found, p2_reasons, p3_found, p3_rolling, p4_found, p4_changes, p5_found, p5_versions, p6_found, p6_grid, p6_weeks, p7_found, p7_known)
}
