import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import day, rows
from pitloom.functions.safe import clip, number, ratio
from pitloom.functions.windows import wilder_rsi
from pitloom.operators import features as X
from pitloom.operators import panel as P
from pitloom.operators.ranks import all_small, percentile_ranks

S = X.FeatureSettings(short=3, medium=5, long=8, rsi=4, year=6)
PANEL = "ticker string, trade_date date, adj_close double, sector string, is_benchmark boolean"


def make(spark, seed=1, days=40, tickers=("a", "b", "m"), poison_after=None):
    rnd, out = random.Random(seed), []
    for t in tickers:
        x = 50.0
        for d in range(days):
            x *= math.exp(rnd.gauss(0, 0.02))
            out.append((t, day(d), 1e6 * (d + 1) if poison_after is not None and d > poison_after else x, "s", t == "m"))
    return spark.createDataFrame(out, PANEL)


def build(df):
    return df.transform(X.add_price_features, S).transform(X.add_market_features, S).transform(X.add_cross_sectional_features, S)


@pytest.fixture(scope="module")
def built(spark):
    return build(make(spark)).toPandas().sort_values(["ticker", "trade_date"]).reset_index(drop=True)


def test_against_pandas(built):
    for _, g in built.groupby("ticker"):
        g = g.reset_index(drop=True)
        r = np.log(g.adj_close / g.adj_close.shift(1))
        delta = g.adj_close.diff()
        up, down = (delta.clip(lower=0)[1:], (-delta.clip(upper=0))[1:])
        ema = lambda s: s.ewm(alpha=1 / S.rsi, adjust=False, min_periods=S.rsi).mean()
        want = {
            "px_ret_1d": r, "px_ret_3d": np.log(g.adj_close / g.adj_close.shift(3)), "px_vol_5d": r.rolling(5).std() * math.sqrt(252), "px_mom_8d": g.adj_close / g.adj_close.shift(8) - 1,
            "px_rsi_4": 100 - 100 / (1 + ema(up) / ema(down)),
        }
        for name, w in want.items():
            assert np.allclose(g[name], w.reindex(g.index), equal_nan=True, atol=1e-9), name


def test_identities(built):
    m = built[built.ticker == "m"].dropna(subset=["mkt_beta_8d"])
    assert len(m) and np.allclose(m.mkt_beta_8d, 1) and np.allclose(m.mkt_corr_8d, 1)
    assert built.px_rsi_4.dropna().between(0, 100).all() and built.mkt_corr_8d.dropna().between(-1, 1).all()
    assert np.allclose(built.groupby("trade_date").cs_market_rank_5d.max().dropna(), 1)


def test_poison_in_the_future_changes_nothing_before(spark, built):
    got = build(make(spark, poison_after=25)).toPandas().sort_values(["ticker", "trade_date"]).reset_index(drop=True)
    early = built.trade_date <= day(25)
    pd.testing.assert_frame_equal(got[early], built[early], check_exact=True)


def test_prefix_and_other_tickers(spark, built):
    got = X.add_price_features(make(spark).where(F.col("trade_date") <= day(20)).where("ticker = 'a'"), S).toPandas().sort_values("trade_date").reset_index(drop=True)
    want = built[(built.ticker == "a") & (built.trade_date <= day(20))][got.columns].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_exact=True)


def test_flat_and_monotone(spark):
    flat = spark.createDataFrame([("f", day(i), 5.0, "s", False) for i in range(12)] + [("u", day(i), 5.0 + i, "s", False) for i in range(12)], PANEL)
    out = {r.ticker: r for r in X.add_price_features(flat, S).where(F.col("trade_date") == day(11)).collect()}
    assert out["f"].px_rsi_4 is None and out["f"].px_vol_ratio is None and out["u"].px_rsi_4 == 100


def test_growth(spark):
    df = spark.createDataFrame([("x", day(i), v) for i, v in enumerate([0.0, 1.0, 2.0, -1.0, 4.0, 5.0, 3.0, 100.0, 1.0])], "ticker string, trade_date date, salesnet double")
    got = [r.fd_growth for r in X.add_fundamental_ratios(df, S).orderBy("trade_date").collect()]
    assert got == [None] * 6 + [5.0, 5.0, -0.5]


def test_labels_and_intervals(spark):
    df = spark.createDataFrame([("x", day(i), p, p) for i, p in enumerate([1.0, 2.0, 1.0])], "ticker string, trade_date date, close double, adj_close double")
    out = P.returns_and_labels(df).orderBy("trade_date").collect()
    assert [r.next_return_positive for r in out] == [True, False, None] and out[0].log_return is None
    dim = spark.createDataFrame([("x", day(0), day(0), "old"), ("x", day(1), None, "new")], "ticker string, a date, b date, sector string")
    assert rows(P.interval_join(df, dim, "ticker", "trade_date", "a", "b", ["sector"]), "trade_date", "sector") == [(day(0), "old"), (day(1), "new"), (day(2), "new")]


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 0.0, "."), (None, 2.0, " 1.5 "), (3.0, 2.0, "x"), (float("nan"), 2.0, "nan")], "a double, b double, t string")
    got = df.select(ratio(F.col("a"), F.col("b")).alias("r"), clip(F.col("a"), 0.0, 2.0).alias("c"), number(F.col("t")).alias("n")).collect()
    assert [r.r for r in got] == [None, None, 1.5, None] and [r.c for r in got][:3] == [1.0, None, 2.0] and [r.n for r in got] == [None, 1.5, None, None]


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    a = rows(P.exact_sample(df, F.col("id"), 50))
    assert {r[-1] for r in a} == {df.count()}
    assert len(a) == 50 and a == rows(P.exact_sample(df.repartition(7), F.col("id"), 50)) and a != rows(P.exact_sample(df, F.col("id"), 50, seed=1))


def test_rsi_of_long_and_resting_series(spark):
    rnd, out, change = random.Random(4), [], []
    for i in range(12_000):
        resting = 3000 < i < 5000 or 8000 < i < 9600 or i > 11_500
        change.append(0.0 if resting else rnd.gauss(0, 1))
    df = spark.createDataFrame([("a", 0, None)] + [("a", i + 1, c) for i, c in enumerate(change)] + [("flat", i, None if i == 0 else 0.0) for i in range(1500)] + [("up", i, None if i == 0 else 1.0) for i in range(40)], "ticker string, trade_date int, change double")
    got = {(r.ticker, r.trade_date): r.rsi for r in wilder_rsi(df, ["ticker"], "change", "rsi").collect()}
    up = down = 0.0
    for i, c in enumerate(change):
        a = 1.0 if i == 0 else 1 / 14
        up, down = up * (1 - a) + max(c, 0.0) * a, down * (1 - a) + max(-c, 0.0) * a
        if i >= 13:
            assert abs(got["a", i + 1] - (100 - 100 / (1 + up / down))) < 1e-8, i
        else:
            assert got["a", i + 1] is None
    assert all(got["flat", i] is None for i in range(1500)) and got["up", 39] == 100


def test_slices_and_kept_columns(spark):
    df = spark.createDataFrame([("a", day(i), i) for i in range(5)] + [("b", None, 9)], "ticker string, trade_date date, x int")
    assert rows(P.date_slice(df, "trade_date", str(day(1)), str(day(2))), "x") == [(1,), (2,)]
    assert rows(P.date_slice(df, "trade_date", None, str(day(0)), ["a"]), "x") == [(0,)] and P.date_slice(df, "trade_date", tickers=["b"]).count() == 1
    assert P.kept_columns(df, ["x", "gone", "ticker"]).columns == ["ticker", "x"]
    assert rows(P.common_dates(df, df.where("x IN (1, 3, 9)")), "x") == [(1,), (3,)]


@pytest.mark.parametrize("seed", range(3))
def test_small_groups_are_ranked_alike(spark, seed):
    rnd = random.Random(seed)
    df = spark.createDataFrame([(rnd.choice(["p", "q", None]), rnd.choice("xy"), rnd.choice([None, 1.0, 2.0, rnd.random()]), i) for i in range(60)], "g string, h string, v double, _value int")
    for keys in (["g"], ["g", "h"]):
        a, b = (percentile_ranks(df.withColumnRenamed("_value", "i"), keys, "v", "r", small=s) for s in (True, False))
        assert rows(a) == rows(b)
    assert all_small(df, ["g"]) and not all_small(df, ["g"], 5)
