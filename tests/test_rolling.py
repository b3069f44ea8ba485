import random
from datetime import timedelta

import pytest

from helpers import day, stamp
from pitloom.operators.rolling import daily_totals, trailing

SCHEMA = "ticker string, trade_date date, volume long, loaded_at timestamp, entity string, day int, value double, after int"


def make(spark, data):
    return spark.createDataFrame([(*r, "clash", 1, 1.0, 1) for r in data], SCHEMA)


@pytest.mark.parametrize("block", [3, 256])
def test_against_brute_force(spark, block):
    rnd = random.Random(1)
    data = [(t, day(d), rnd.choice([None, 5, 7, 100]), stamp(rnd.randrange(9))) for t in "ab" for d in rnd.sample(range(90), 40) for _ in range(rnd.choice([1, 1, 2]))]
    last = {}
    for t, d, v, at in data:
        key = (at, v is not None, v or 0)
        if key > last.get((t, d), ((stamp(-1), False, 0), 0))[0]:
            last[t, d] = (key, v or 0)
    got = {(r.entity, r.day): r for r in trailing(daily_totals(make(spark, data), "ticker", "trade_date", "volume", "loaded_at"), block_days=block).collect()}
    for t in "ab":
        days = sorted(d for u, d in last if u == t)
        d = days[0]
        n = 0
        while d <= days[-1]:
            for k in (7, 30):
                total = sum(last.get((t, d - timedelta(days=i)), (0, 0))[1] for i in range(k))
                assert (got[t, d][f"total_{k}"], round(got[t, d][f"mean_{k}"], 9)) == (total, round(total / k, 9))
            d, n = d + timedelta(days=1), n + 1
        assert n == sum(1 for u, _ in got if u == t)


def test_without_versions_rows_add_up(spark):
    out = daily_totals(make(spark, [("a", day(0), 2, None), ("a", day(0), 3, None)]), "ticker", "trade_date", "volume")
    assert [r.value for r in out.collect()] == [5]


def test_nulls_and_empty(spark):
    assert trailing(daily_totals(make(spark, []), "ticker", "trade_date", "volume", "loaded_at")).count() == 0
    data = [(None, day(0), 1, stamp(0)), ("a", None, 1, stamp(0)), ("a", day(1), None, None)]
    got = trailing(daily_totals(make(spark, data), "ticker", "trade_date", "volume", "loaded_at")).collect()
    assert [(r.entity, r.day, r.total_7, r.total_30) for r in got] == [("a", day(1), 0, 0)]
