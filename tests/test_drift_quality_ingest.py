import math
import random

import numpy as np
from pyspark.sql import functions as F

from helpers import day, rows, stamp
from pitloom.operators import drift as D
from pitloom.operators import ingest as I
from pitloom.operators import quality as Q


def test_drift(spark):
    rng = np.random.default_rng(0)
    ref, same, moved = rng.normal(size=2000), rng.normal(size=2000), rng.normal(2, 1, size=2000)
    data = [("ref", "same", x) for x in ref] + [("cur", "same", x) for x in same] + [("ref", "moved", x) for x in ref] + [("cur", "moved", x) for x in moved] + [("ref", "one", 1.0)]
    df = spark.createDataFrame([(a, b, float(x)) for a, b, x in data], "part string, feature string, x double")
    psi = {r.feature: r.psi for r in D.psi(D.counted(df)).collect()}
    edges = np.quantile(ref, np.linspace(0, 1, 11))[1:-1]
    share = lambda v: np.clip(np.bincount(np.searchsorted(edges, v, side="right"), minlength=10) / len(v), 1e-6, None)
    for name, cur in (("same", same), ("moved", moved)):
        assert math.isclose(psi[name], float(np.sum((share(cur) - share(ref)) * np.log(share(cur) / share(ref)))), rel_tol=1e-9)
    assert psi["one"] is None
    ks = {r.feature: r for r in D.ks(D.counted(df)).collect()}
    grid = np.sort(np.concatenate([ref, moved]))
    assert math.isclose(ks["moved"].ks_stat, np.abs(np.searchsorted(np.sort(ref), grid, side="right") - np.searchsorted(np.sort(moved), grid, side="right")).max() / 2000)
    assert ks["one"].ks_stat is None
    p = {r.feature: r.p for r in D.ks(D.counted(df)).withColumn("p", D.ks_p_value(F.col("ks_stat"), F.col("n_ref"), F.col("n_cur"))).collect()}
    assert p["moved"] < 1e-6 < p["same"] <= 1 and p["one"] is None


def test_exact_ks_p():
    # all orderings of 3 and 2 values are equally likely: 10, of which 2 reach the largest distance 1
    assert math.isclose(D.exact_ks_p(1.0, 3, 2), 0.2) and D.exact_ks_p(0.0, 3, 2) == 1.0


def test_windows_and_freshness(spark):
    df = spark.createDataFrame([(day(i), float(i)) for i in range(10)], "trade_date date, v double")
    got = D.windows(df, "trade_date", 3, 2)
    assert rows(got, "v", "part") == sorted([(0.0, "ref"), (1.0, "ref"), (2.0, "ref"), (8.0, "cur"), (9.0, "cur")], key=repr)
    assert D.windows(df, "trade_date", 6, 5).count() == 0
    fresh = D.freshness({"a": (df, "trade_date", 3, 7), "b": (df.where("false"), "trade_date", 3, 7)}, F.lit(day(13)))
    assert rows(fresh, "mart", "age_days", "status") == [("a", 4, "WARN"), ("b", None, "FAIL")]


def test_tail_mean(spark):
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate([9.0, 1.0, None, 2.0, 3.0])], "model string, fold int, auc double")
    assert rows(D.tail_mean(df, ["model"], "fold", ["auc"], 3), "mean") == [(2.0,)]


def test_contract(spark):
    schema = "ticker string, open double, high double, low double, close double, volume long"
    df = spark.createDataFrame([("a", 1.0, 2.0, 0.5, 1.5, 3), ("a", 1.0, 0.9, 0.5, 1.5, -3), (None, None, None, None, None, None)], schema)
    c = Q.Contract("c", {"ticker": "string", "open": "int", "gone": "string"}, Q.not_null("ticker") | Q.ohlc_rules() | Q.between("volume", 0, 10), ("ticker",))
    got = {r.rule: r.violations for r in Q.check(df, c).collect()}
    assert got == {"not_empty": 0, "not_null:ticker": 1, "positive": 0, "high": 1, "low": 0, "volume": 1, "between:volume": 1, "column:ticker": 0, "column:open": 1, "column:gone": 1, "unique": 1}
    assert {r.rule: r.violations for r in Q.check(df.where("false"), c).collect()}["not_empty"] == 1
    assert Q.gate(Q.check(df, c)).first().passed is False
    bad = Q.violations(df, Q.ohlc_rules(), ["ticker", "volume"])
    assert rows(Q.first_failures(bad, ["ticker", "volume"], 2)) == [("high", 1, ["a -3"]), ("volume", 1, ["a -3"])]
    parent = spark.createDataFrame([("b",), (None,)], "t string")
    assert rows(Q.orphans(df, "ticker", parent, "t")) == [("a",)]


BARS = "source string, ticker string, trade_date date, open double, high double, low double, close double, adj_close double, volume long"


def bar(t, d, o=2.0, h=3.0, l=1.0, c=2.5, a=2.5, v=7):  # noqa: E741
    return ("s", t, None if d is None else day(d), o, h, l, c, a, v)


def test_first_violation(spark):
    data = [bar("twice", 0), bar("twice", 0, v=-1), bar("null", 3, a=None), bar("null", 1, l=9.0)] + [bar("low", d, o=0.5) for d in (5, 2, 4, 1)] + [bar("fine", 0), bar("vol", 1, v=-2), bar(None, None, v=-2)]
    got = rows(Q.first_violation(spark.createDataFrame(data, BARS), ["ticker"], "trade_date", Q.bar_rules()))
    d = lambda *n: ",".join(str(day(k)) for k in n)
    assert set(got) == {("twice", "duplicate", d(0)), ("null", "missing", d(3)), ("low", "low>open", d(1, 2, 4)), ("vol", "volume", d(1)), (None, "volume", "none")}
    assert Q.first_violation(spark.createDataFrame([], BARS), ["ticker"], "trade_date", Q.bar_rules()).count() == 0


def test_bar_events(spark):
    data = [bar("a", 0), bar("a", 0), bar("a", 0, c=2.6), bar("b", 0, v=-1), bar("c", 0, a=None), bar("x" * 17, 0), bar("d", None), bar(None, 0)]
    got = rows(Q.bar_events(spark.createDataFrame(data, BARS)))
    assert [g[1] for g in got] == ["a", "a"] and all(g[3].startswith(f"s:a:{day(0)}:") for g in got)


def test_strict_contract_groups_and_gate(spark):
    df = spark.createDataFrame([("a", 1), ("a", -1), ("b", 2), (None, -3)], "t string, x int")
    c = Q.Contract("c", {"t": "string", "x": "bigint"}, {"positive": F.col("x") > 0}, strict=True)
    found = dict(rows(Q.check(df.withColumn("more", F.lit(1)), c), "rule", "violations"))
    assert found == {"not_empty": 0, "positive": 2, "column:t": 0, "column:x": 1, "other_columns": 1}
    assert rows(Q.check_groups(df, c, ["t"])) == [("a", 2, 1, 1), ("b", 1, 0, 0), (None, 1, 1, 1)]
    ok = Q.Contract("ok", {"t": "string"}, {"known": F.lit(True)})

    def gone():
        raise FileNotFoundError("no such table")

    layers, code = Q.run_gate({"c": lambda: df, "ok": lambda: df, "gone": gone}, [c, ok, Q.Contract("gone"), Q.Contract("later")], skip=("later",))
    assert [(x.name, x.status) for x in layers] == [("c", "fail"), ("ok", "pass"), ("gone", "fail"), ("later", "skip")] and code == 1
    assert layers[0].broken == {"positive": 2, "column:x": 1} and "no such table" in layers[2].error
    assert Q.run_gate({"ok": lambda: df}, [ok])[1] == 0


def test_performance(spark):
    data = [("m", k, a, 0.7, None) for k, a in enumerate([0.9, 0.9, 0.47, 0.47, 0.49, 0.47])] + [("n", 0, None, 0.9, 1.0)]
    df = spark.createDataFrame(data, "model string, fold int, auc double, log_loss double, sharpe double")
    got = {(r.model, r.metric): (r.mean, r.status) for r in D.performance(df, ["model"], "fold").collect()}
    assert got["m", "auc"][1] == "FAIL" and got["m", "log_loss"][1] == "PASS" and got["m", "sharpe"] == (None, "PASS")
    assert got["n", "auc"] == (None, "PASS") and got["n", "log_loss"] == (0.9, "FAIL") and got["n", "sharpe"] == (1.0, "PASS")
    assert rows(D.overall(D.performance(df, ["model"], "fold"), ["model"])) == [("m", "FAIL"), ("n", "FAIL")]


def test_exact_p_in_the_report(spark):
    data = [("ref", "small", float(k)) for k in range(6)] + [("cur", "small", k + 4.5) for k in range(5)] + [(p, "large", float(k)) for p in ("ref", "cur") for k in range(60)]
    df = spark.createDataFrame(data, "part string, feature string, x double")
    exact, series = ({r.feature: r.ks_pvalue for r in D.drift_of(df, n).collect()} for n in (100, 0))
    assert exact["large"] == series["large"] and abs(exact["small"] - D.exact_ks_p(5 / 6, 6, 5)) < 1e-12 and exact["small"] != series["small"]
    assert rows(D.worst_first(D.drift_of(df), 1, ["feature"]), "feature") == [("small",)]


def test_normalise(spark):
    schema = "Date string, Open double, High double, Low double, Close double, Volume long, n long"
    df = spark.createDataFrame([("2021-01-04 23:30:00", 1.0, 2.0, 0.5, 1.5, None, 1), ("2021-01-04 05:00:00", 1.0, 2.0, 0.5, 1.6, 7, 2), ("2021-01-05", float("nan"), 1.0, 1.0, 1.0, 1, 3)], schema)
    names = {"Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
    assert rows(I.normalise_bars(df, names, F.lit("x"), "n"), "ticker", "trade_date", "close", "adj_close", "volume") == [("x", day(0), 1.6, 1.6, 7)]


def test_vintages_from_intervals(spark):
    rnd = random.Random(3)
    iv = [("s", day(rnd.randrange(4)), day(b), day(b + rnd.randrange(30)), rnd.random()) for b in rnd.sample(range(40), 20)] + [("s", None, day(1), day(2), 1.0)]
    df = spark.createDataFrame([(s, o and str(o), str(b), str(e), v) for s, o, b, e, v in iv] + [("s", "bad", "2021-01-01", "x", 1.0)], "series_id string, observation_date string, realtime_start string, realtime_end string, value double")
    want = set()
    for v in {b for _, o, b, _, _ in iv if o}:
        for o in {o for _, o, _, _, _ in iv if o}:
            held = [(b, x) for _, p, b, e, x in iv if p == o and b <= v <= e]
            if held:
                want.add(("s", o, v, max(held)[1]))
    got = I.vintages_from_intervals(df)
    assert set(rows(got, "series_id", "observation_date", "vintage_date", "value")) == want


def test_facts_document(spark):
    doc = '{"facts": {"ns": {"T": {"units": {"USD": [{"end": "2021-03-31", "val": 5, "fy": 2021, "fp": " ", "form": "10-K-and-much-too-long", "filed": "2021-04-01"}, {"val": 1}, {"end": "2021-03-31", "val": "x", "form": "8-K", "filed": "2021-04-02", "frame": "F"}]}}, "U": {"label": "no units"}}}}'
    df = spark.createDataFrame([("x", doc), ("y", "{}"), ("z", "not json"), ("n", None)], "t string, d string")
    got = sorted((r.ticker, r.namespace, r.tag, r.unit, str(r.filed), r.form, r.fiscal_period, r.value) for r in I.flatten_facts(df, "d", "t").collect())
    assert [(g[:6], g[6], g[7]) for g in got] == [(("x", "ns", "T", "USD", "2021-04-01", "10-K-and-much-to"), None, 5.0), (("x", "ns", "T", "USD", "2021-04-02", "8-K"), None, None)]


def test_curated_by_join(spark):
    facts = spark.createDataFrame([("n", "a", 1), ("n", "b", 2), ("m", "a", 3), (None, "a", 4)], "namespace string, tag string, x int")
    tags = I.tag_table(spark, ["n:a", "n:a", "m:c", "broken", ":x"])
    assert rows(tags) == [("m", "c"), ("n", "a")] and rows(I.curated(facts, tags), "x") == [(1,)]


def test_facts_beside_other_shapes(spark):
    good = '{"end":"2021-03-31","val":5,"form":"10-K","filed":"2021-04-01"}'
    unit = f'{{"units":{{"USD":[{good}]}}}}'
    docs = [
        f'{{"facts":{{"ns":{{"T":{unit}}}}}}}', f'{{"facts":{{"ns":{{"T":{unit},"U":"text"}}}}}}', f'{{"facts":{{"ns":{{"T":{unit}}},"list":[1]}}}}', f'{{"facts":{{"ns":{{"T":{{"units":{{"USD":[{good}],"EUR":"text"}}}}}}}}}}',
        f'{{"facts":{{"ns":{{"T":{{"units":{{"USD":[{good},7,null,"x",[{good}]]}}}}}}}}}}', f'{{"facts":{{"ns":{{"T":{unit},"U":{{"units":3}}}}}}}}', '{"facts":[1]}', '{"facts":"x"}', f'[{unit}]',
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "t int, d string")
    assert rows(I.flatten_facts(df, "d", "t"), "ticker", "tag", "unit", "value") == [(i, "T", "USD", 5.0) for i in range(6)]


def test_stamp_is_used():
    assert stamp(0).date() == day(0)
