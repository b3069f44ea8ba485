import pytest

from helpers import day, rows
from pitloom.operators.spikes import spike_cases, spike_rows

SCHEMA = "row_id long, source string, ticker string, trade_date date, open double, high double, close double, volume long, load_id long, field string, margin double"


def bars(n=60, ticker="x", **change):
    """A quiet series; ``change`` maps a field to {bar: value}."""
    out = []
    for i in range(n):
        close = 100 + (i * 7 % 5) * 0.4
        bar = {"open": close, "high": close + 0.5 + (i % 3) * 0.1, "close": close, "volume": 1000 + (i * 37 % 11) * 40}
        for f, values in change.items():
            bar[f] = values.get(i, bar[f])
        out.append((i, "s", ticker, day(i), bar["open"], bar["high"], bar["close"], bar["volume"], i // 20, "clash", 0.0))
    return out


def found(spark, data):
    return rows(spike_rows(spark.createDataFrame(data, SCHEMA)))


def test_quiet(spark):
    assert found(spark, bars()) == []


@pytest.mark.parametrize("length,case", [(1, True), (2, True), (3, False)])
def test_length_of_a_jump(spark, length, case):
    up = {30 + k: 130.0 for k in range(length)}
    got = found(spark, bars(close=up, high={k: 131.0 for k in up}))
    assert ([r for r in got if r[1] == "close"] == [(k, "close") for k in up]) == case


def test_down_only_for_close(spark):
    assert found(spark, bars(close={30: 70.0})) == [(30, "close")]
    assert found(spark, bars(volume={30: 10})) == []
    assert found(spark, bars(volume={30: 90_000})) == [(30, "volume")]


def test_spike_in_a_month_of_few_bars(spark):
    # the series ends on the third day of a month, whose own range would be the spike's
    assert found(spark, bars(59, close={57: 130.0}, high={57: 131.0})) == [(57, "close"), (57, "high")]
    assert found(spark, bars(59)) == []


def test_level_shift_is_none(spark):
    assert found(spark, bars(close={k: 50.0 + k % 3 for k in range(30, 60)}, high={k: 53.0 + k % 3 for k in range(30, 60)}, open={k: 50.0 for k in range(30, 60)})) == []


def test_impossible(spark):
    got = found(spark, bars(close={10: -3.0, 11: 0.0}, high={20: 90.0}, volume={30: -5}))
    assert got == [(10, "close"), (11, "close"), (20, "high"), (30, "volume")]


def test_hanging(spark):
    assert found(spark, bars(volume={k: 7777 for k in range(20, 27)})) == [(k, "volume") for k in range(21, 27)]
    assert found(spark, bars(volume={k: 7777 for k in range(20, 26)})) == []
    assert found(spark, bars(volume={k: 7777 for k in range(60)})) == []


def test_every_row_of_a_repeated_bar(spark):
    data = bars(close={30: 70.0})
    again = (900, *data[30][1:])
    assert found(spark, data + [again]) == [(30, "close"), (900, "close")]


def test_nulls_and_empty(spark):
    assert found(spark, [tuple([None] * 11)]) == []
    assert spike_cases(spark.createDataFrame([], SCHEMA)).count() == 0
    holes = bars(volume={k: None for k in (28, 29, 31, 45)} | {30: 90_000})
    assert found(spark, holes) == [(30, "volume")]
    nameless = [(r[0], None, None, *r[3:]) for r in bars(close={30: 70.0})]
    assert found(spark, nameless) == [(30, "close")]
    dateless = [(r[0], *r[1:3], None, *r[4:]) for r in bars(close={30: -1.0})]
    assert found(spark, dateless) == []
