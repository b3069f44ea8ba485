import random
import statistics

import pytest
from pyspark.sql import functions as F

from helpers import rows
from pitloom.functions.masks import mask, number_mask
from pitloom.operators import profile as P

SCHEMA = "source string, load_id long, ticker string, low double, psi string, mask string, rank int, number double, column string"
LOW = [P.ColumnContract("low", least=0.0, strict=True)]
PSI = [P.ColumnContract("psi", least=0.0, format="-?[0-9]+[.][0-9]+")]


def table(spark, data):
    return spark.createDataFrame([(s, l, t, x, p, "clash", 1, 1.0, "c") for s, l, t, x, p in data], SCHEMA)


def far_by_hand(data, factor=5.0):
    out = {}
    for s, l, t, x, _ in data:
        if x is None:
            continue
        others = [y for s2, l2, t2, y, _ in data if s2 == s and t2 == t and l2 != l and y is not None]
        if others:
            m = statistics.median(others)
            out[s, l] = out.get((s, l), 0) + (x > factor * m or x < m / factor)
        else:
            out.setdefault((s, l), 0)
    return out


def test_mask(spark):
    df = spark.createDataFrame([("ab-12.5 x",), ("",), (None,), ("Ünï 3",)], "t string")
    assert [r[0] for r in df.select(mask(df.t)).collect()] == ["a-9.9_a", "", None, "a_9"]


@pytest.mark.parametrize("hot", [2_000_000, 7])
@pytest.mark.parametrize("sign", [1, -1])
def test_far_counts_against_brute_force(spark, hot, sign):
    rnd = random.Random(3)
    data = [(s, l, t, rnd.choice([0.0, sign * 1.0, sign * 2.0, sign * 3.0, 50.0, None]) if rnd.random() < 0.6 and rnd.random() < 0.9 else rnd.uniform(-0.1, 30), None) for s in "ab" for l in range(4) for t in ("x", "y", "z") for _ in range(rnd.choice([0, 1, 3, 9]))]
    data += [("a", 9, "lonely", 4.0, None)]
    limits, df = P.Departures(hot_rows=hot), table(spark, data)
    values = P._drawn(df, LOW, "source", "load_id", "ticker")
    hand = far_by_hand(data)
    found = {(r["source"], r["load"]): r["n"] for r in P.far_counts(values, limits).groupBy("source", "load").agg(F.sum("n_far").alias("n")).collect()}
    assert all(found.get(k, 0) == v for k, v in hand.items())
    bounds = P.far_bounds(P.cells(df, LOW, "source", "load_id", "ticker"), limits).groupBy("source", "load").agg(F.sum("least_far").alias("a"), F.sum("most_far").alias("b"))
    assert all(r["a"] <= hand[r["source"], r["load"]] <= r["b"] for r in bounds.collect())
    n = {k: sum(1 for s, l, _, x, _ in data if (s, l) == k and x is not None) for k in hand}
    for share in (0.2, 0.34, 0.5, 0.9):
        limits = P.Departures(hot_rows=hot, far_share=share)
        got = P._far_loads(df, LOW, "source", "load_id", "ticker", P.cells(df, LOW, "source", "load_id", "ticker"), limits)
        assert rows(got, "source", "load") == sorted(k for k, v in hand.items() if v >= share * n[k])


def test_number_masks_keep_the_order(spark):
    rnd = random.Random(1)
    x = sorted([rnd.choice([-1, 1]) * rnd.uniform(1, 10) * 10.0 ** rnd.randint(-320, 307) for _ in range(500)] + [0.0, 9.999999999999999, 10.0, 10.000000000000002, 1000.0, 999.9999999999999, float("inf"), float("-inf"), 5e-324, 1.7e308])
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(number_mask(F.col("x"))).collect()]
    assert got == sorted(got) and got[x.index(0.0)] == 0
    assert [r[0] for r in spark.createDataFrame([(None,)], "x double").select(number_mask(F.col("x"))).collect()] == [None]


def test_issues(spark):
    fine = [("s", l, "x", 10.0 + i * 0.1 + l * 0.01, f"0.{i:02d}{l}") for l in range(3) for i in range(40)]
    bad = [("s", 7, "x", -1.0 if i == 0 else 100.0 if i < 25 else None, "0,5" if i == 0 else "-0.1" if i == 1 else "0.2") for i in range(40)]
    got = P.departures(table(spark, fine + bad), LOW, "source", "load_id", "ticker")
    assert rows(got, "load", "column_name", "issue") == sorted([(7, "low", i) for i in ("null_rate", "range", "distribution", "distinct")], key=repr)
    psi = rows(P.departures(table(spark, fine + bad), PSI, "source", "load_id"), "load", "issue")
    assert (7, "pattern") in psi and (7, "range") in psi and (7, "distinct") in psi


def test_nulls_empty_and_single_load(spark):
    nothing = table(spark, []).where("false")
    assert P.departures(nothing, LOW, "source", "load_id", "ticker").count() == 0
    nulls = table(spark, [(None, None, None, None, None)] * 3)
    for contracts in (LOW, PSI):
        assert P.departures(nulls, contracts, "source", "load_id", "ticker").count() == 0
        assert P.mask_profile(nulls, contracts, "source", "load_id").count() == 0
    nameless = table(spark, [(None, None, None, 0.0, "x")] + [(None, 2, None, 10.0 + i, "0.1") for i in range(9)])
    assert rows(P.departures(nameless, LOW, "source", "load_id", "ticker"), "source", "load", "issue") == [(None, 2, "distribution"), (None, None, "distribution"), (None, None, "range")]
    assert rows(P.departures(nameless, PSI, "source", "load_id"), "load", "issue") == [(None, "pattern")]
    one = table(spark, [("s", 1, "x", 0.0, "n/a"), ("s", 1, "x", 0.0, "")])
    assert rows(P.departures(one, LOW, "source", "load_id", "ticker"), "issue") == [("range",)]
    assert rows(P.departures(one, PSI, "source", "load_id"), "issue") == [("pattern",)]


def test_divergence_and_rare_masks(spark):
    data = [("s", l, "x", 1.0, "0.5") for l in range(3) for _ in range(200)] + [("s", 2, "x", 1.0, "0,5")]
    limits = P.Departures()
    assert {(r.mask, r.rare) for r in P.mask_profile(table(spark, data), PSI, "source", "load_id", limits).collect()} == {("9.9", False), ("9,9", True)}
    d = {r.load: r for r in P.mask_divergence(table(spark, data), PSI, "source", "load_id", limits).collect()}
    assert d[2].n_rare == 1 and d[2].divergence > d[0].divergence > 0
