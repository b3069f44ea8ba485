import random
from datetime import datetime, timedelta

import pytest

from helpers import day, rows
from pitloom.operators.grid import time_grid, weekday_grid
from pitloom.operators.known import as_known, filing_changes, vintage_changes

D0 = datetime(2021, 1, 4)
READINGS = "row_id long, trade_date date, series_id string, value double, day string, until int, w int, series string"


def grid(spark, data, **k):
    df = spark.createDataFrame([(i, *r, "clash", 1, 1, "clash") for i, r in enumerate(data)], READINGS)
    return {(r.series, r.day): r for r in weekday_grid(df, "series_id", "trade_date", "value", "row_id", **k).collect()}


def test_gaps_weekends_and_nulls(spark):
    # day 0 is a Monday; 5 and 6 are a weekend
    got = grid(spark, [(day(0), "s", 1.0), (day(1), "s", None), (day(5), "s", 4.0), (day(8), "s", 2.0), (day(8), "s", 3.0), (day(9), "s", None)])
    assert [d for (_, d), r in sorted(got.items()) if r.missing] == [day(1), day(2), day(3), day(4), day(9)]
    assert (got["s", day(7)].value, round(got["s", day(7)].coverage, 4)) == (4.0, 0.3333)
    assert (got["s", day(8)].value, got["s", day(4)].filled) == (3.0, 1.0)


def test_time_weighted_mean_and_hold(spark):
    got = grid(spark, [(day(5), "s", 4.0), (day(7), "s", 1.0)], hold_days=3)
    assert got["s", day(7)].value == 3.0 and got["s", day(7)].coverage == 1.0
    held = grid(spark, [(day(0), "s", 4.0), (day(4), "s", 1.0)], hold_days=3)
    assert [held["s", day(k)].value for k in range(5)] == [4.0, 4.0, 4.0, None, 1.0]


def test_grid_of_nothing(spark):
    assert grid(spark, []) == {}
    assert grid(spark, [(None, None, None), (None, "s", 1.0), (day(1), None, 1.0)]) == {}
    assert [r.missing for r in grid(spark, [(day(1), "s", None)]).values()] == [True]


def grid_by_hand(data, step, hold):
    out = {}
    for s in {d[1] for d in data}:
        mine = sorted((t, i, x) for i, (t, s2, x) in enumerate(data) if s2 == s)
        held = {t: x for t, _, x in mine if x is not None}
        times, last = sorted(held), None
        for k in range(mine[0][0] // step, mine[-1][0] // step + 1):
            total = weight = 0
            for j, t in enumerate(times):
                end = min(t + hold, times[j + 1] if j + 1 < len(times) else t + hold)
                w = max(0, min(end, (k + 1) * step) - max(t, k * step))
                total, weight = total + w * held[t], weight + w
            last = total / weight if weight else last
            out[s, k] = (round(total / weight, 9) if weight else None, round(weight / step, 9), None if last is None else round(last, 9), not weight)
    return out


@pytest.mark.parametrize("step,hold,block", [(60, 45, 4), (60, 500, 3), (7, 100, 1), (3600, 30, 4096)])
def test_time_grid_against_brute_force(spark, step, hold, block):
    rnd = random.Random(step)
    data = [(rnd.randrange(4000), s, rnd.choice([None, round(rnd.uniform(-5, 5), 3)])) for s in "abc" for _ in range(60)] + [(9000, "a", 1.0), (20_000, "a", 2.0), (5, "nulls", None)]
    df = spark.createDataFrame([(D0 + timedelta(seconds=t), s, x, i, "clash", 1) for i, (t, s, x) in enumerate(data)], "at timestamp, s string, x double, n int, cell string, w int")
    got = time_grid(df, "s", "at", "x", "n", timedelta(seconds=step), timedelta(seconds=hold), D0 - datetime(1970, 1, 1), block).collect()
    r9 = lambda v: None if v is None else round(v, 9)
    assert {(r.series, (r.cell - D0) // timedelta(seconds=step)): (r9(r.value), r9(r.coverage), r9(r.filled), r.missing) for r in got} == grid_by_hand(data, step, hold)


def test_time_grid_of_nothing(spark):
    df = spark.createDataFrame([(None, "s", 1.0, 1), (D0, None, 1.0, 1), (D0, "nan", float("nan"), 1)], "at timestamp, s string, x double, n int")
    a_day = timedelta(days=1)
    assert rows(time_grid(df, "s", "at", "x", "n", a_day, a_day), "series", "value", "missing") == [("nan", None, True)]
    with pytest.raises(ValueError):
        time_grid(df, "s", "at", "x", "n", timedelta(0), a_day)


SERIES = "series_id string, observation_date date, vintage_date date, value double, number int, on date"
EVENTS = "row_id long, series_id string, trade_date date, number string, known_value double, k0 int"


def test_vintages_against_brute_force(spark):
    rnd = random.Random(5)
    data = [(s, day(rnd.randrange(60)), v, rnd.choice([None, rnd.random()])) for s in "ab" for v in [day(x) for x in rnd.sample(range(60), 12)] for _ in range(5)]
    once = {}
    for s, o, v, x in data:
        old = once.get((s, v, o))
        once[s, v, o] = x if old is None or (x is not None and x > old) else old
    events = [(i, rnd.choice("abc"), day(rnd.randrange(-3, 70))) for i in range(150)]
    changes = vintage_changes(spark.createDataFrame([(*r, 1, day(0)) for r in data], SERIES)).withColumnRenamed("series", "series_id")
    df = spark.createDataFrame([(*e, "clash", 9.0, 1) for e in events], EVENTS)
    got = {r.row_id: r for r in as_known(df, changes, ["series_id"], "trade_date", "on", ["vintage", "observed", "value"]).collect()}
    assert len(got) == len(events)
    for i, s, t in events:
        v = max((v for (u, v, _) in once if u == s and v <= t), default=None)
        o = max((o for (u, w, o) in once if u == s and w == v and o <= t), default=None)
        r = got[i]
        assert (r.known_vintage, r.known_observed, r.known_value) == ((v, o, once[s, v, o]) if o is not None else (None, None, None))


def test_known_nulls_and_empty(spark):
    events = spark.createDataFrame([(1, None, None, None, None, None), (2, "a", None, None, None, None), (3, None, day(3), None, None, None)], EVENTS)
    empty = vintage_changes(spark.createDataFrame([], SERIES)).withColumnRenamed("series", "series_id")
    nulls = vintage_changes(spark.createDataFrame([tuple([None] * 6)], SERIES)).withColumnRenamed("series", "series_id")
    for changes in (empty, nulls):
        got = as_known(events, changes, ["series_id"], "trade_date", "on", ["value"])
        assert rows(got, "row_id", "known_value") == [(1, None), (2, None), (3, None)]
        assert got.columns == ["row_id", "series_id", "trade_date", "number", "k0", "known_value"]
    assert as_known(events.where("false"), empty, ["series_id"], "trade_date", "on", ["value"]).count() == 0


def test_filings(spark):
    schema = "ticker string, namespace string, tag string, period_start date, period_end date, filed date, form string, value double, last int"
    data = [
        ("x", "n", "t", day(0), day(30), day(40), "10-Q", 1.0, 1), ("x", "n", "t", day(-60), day(30), day(40), "10-K", 2.0, 1), ("x", "n", "t", None, day(20), day(40), "10-Q", 3.0, 1),
        ("x", "n", "t", None, day(50), day(40), "10-Q", 4.0, 1), ("x", "n", "t", day(0), day(30), day(41), "8-K", 5.0, 1), ("x", "n", "t", day(0), day(30), day(42), "10-Q", None, 1), (None,) * 8 + (1,),
    ]
    assert rows(filing_changes(spark.createDataFrame(data, schema))) == [("x", "n", "t", day(40), 2.0, day(30))]
    assert filing_changes(spark.createDataFrame([], schema)).count() == 0
