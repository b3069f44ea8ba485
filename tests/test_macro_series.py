"""Series of one kind stay apart, and their change is that of a year."""

from datetime import timedelta

import pytest

from helpers import day
from pitloom.plans import reference


def test_each_series_has_its_own_yearly_change(spark, tmp_path):
    vintages = [day(0) + timedelta(days=k) for k in range(0, 400, 7)]
    data = [(name, v, v, start + step * k) for name, start, step in (("CORECPI000001", 100.0, 1.0), ("CORECPI000002", 3.0, -0.01), ("NEWKIND000003", 5.0, 0.5)) for k, v in enumerate(vintages)]
    spark.createDataFrame(data, "series_id string, observation_date date, vintage_date date, value double").write.parquet(f"{tmp_path}/stg_macro_series.parquet")
    got = reference.mc_yoy_by_series(spark, str(tmp_path)).collect()
    last = {r.series_id: r for r in got if r.trade_date == vintages[-1]}
    assert sorted(last) == ["CORECPI000001", "CORECPI000002", "NEWKIND000003"]
    # 252 weekdays before a Monday is a Thursday: 50 weeks and two weekdays, so the value of 51 vintages before
    want = {n: ((a + s * 57) / (a + s * 6) - 1) * 100 for n, a, s in (("CORECPI000001", 100.0, 1.0), ("CORECPI000002", 3.0, -0.01), ("NEWKIND000003", 5.0, 0.5))}
    assert {n: r.value_yoy for n, r in last.items()} == pytest.approx(want, abs=1e-6)
    assert all(r.value_yoy is None for r in got if (r.trade_date - day(0)).days < 350)
