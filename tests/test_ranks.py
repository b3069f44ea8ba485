import random

import numpy as np
import pandas as pd
import pytest

from pitloom.operators.ranks import percentile_ranks, quantiles, running


def data(seed=2, n=400):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", "b", "b", None]), rnd.choice([None, rnd.randrange(5) / 2, rnd.random()])) for _ in range(n)]


@pytest.mark.parametrize("hot", [2_000_000, 11])
def test_percentile_ranks(spark, hot):
    rows = data()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, k string, x double")
    got = {r.id: r.p for r in percentile_ranks(df, ["k"], "x", "p", hot).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "x"])
    want = pdf.groupby("k")["x"].rank(pct=True)
    for i in range(len(rows)):
        w = want[i] if rows[i][0] is not None else float("nan")
        assert (got[i] is None and np.isnan(w)) or abs(got[i] - w) < 1e-12


@pytest.mark.parametrize("hot", [2_000_000, 11])
@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles(spark, hot, keys):
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(data(), "k string, x double")
    pdf = df.toPandas()
    groups = pdf.groupby("k", dropna=False)["x"] if keys else [(None, pdf["x"])]
    want = {(None if not isinstance(k, str) else k): np.quantile(x.dropna(), at) for k, x in groups}
    got = {r.k if keys else None: r.quantiles for r in quantiles(df, keys, "x", at, hot).collect()}
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, x double, c long")
    assert running(df, ["k"], "x", ["c"]).count() == 0
    assert quantiles(df, ["k"], "x", [0.5]).count() == 0
