"""Drift is reported for every feature over the reference's windows."""

from pitloom.plans import reference
from pitloom.session import read


def test_every_feature_and_series_is_reported(spark, base):
    got = {r.feature: r for r in reference.drift_status(spark, base).collect()}
    series = {r.series_id for r in read(spark, base, "stg_macro_series").select("series_id").distinct().collect()}
    assert {"close", "volume", *reference.DRIFT_COLUMNS} <= {*got} and {f"macro:{s}" for s in series} <= {*got}
    bars = reference.bars_in_force(spark, base).toPandas()
    dates = sorted(bars.trade_date.unique())
    close = bars[bars.close.notna()].trade_date
    assert (got["close"].n_ref, got["close"].n_cur) == (close.isin(dates[:60]).sum(), close.isin(dates[-60:]).sum())
    assert got["close"].psi > 0 and got["close"].status in ("PASS", "WARN", "FAIL")
