from pyspark.sql import functions as F

from helpers import day, rows
from pitloom.operators.snapshots import redelivered_changes, snapshot_changes

SCHEMA = "source string, no long, ticker string, hash string, size int, change string, to string, sign int, value string"


def changes(spark, data, fields=("hash", "size")):
    df = spark.createDataFrame([(*r, "clash", "clash", 1, "clash") for r in data], SCHEMA)
    out = snapshot_changes(df, ["source"], "no", ["ticker"], {f: F.lower(f) if f == "hash" else F.col(f) for f in fields})
    return rows(out, "source", "no", "ticker", "change", F.array_join("fields", ","))


def test_added_removed_changed(spark):
    data = [("s", 1, "a", "X", 1), ("s", 1, "b", "x", 1), ("s", 4, "a", "x", 2), ("s", 4, "c", "y", 1), ("s", 4, "c", "Y", 1), ("t", 2, "a", "q", 1)]
    assert changes(spark, data) == [("s", 4, "a", "changed", "size"), ("s", 4, "b", "removed", ""), ("s", 4, "c", "added", "")]


def test_null_is_a_value_and_letter_case_is_not(spark):
    data = [("s", 1, "a", None, None), ("s", 2, "a", "x", None), ("s", 3, "a", "X", None), ("s", 4, "a", None, None), ("s", 5, "a", None, None)]
    assert changes(spark, data) == [("s", 2, "a", "changed", "hash"), ("s", 4, "a", "changed", "hash")]


def test_null_keys_and_empty(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(None, None, None, None, None)]) == []
    data = [(None, 1, None, "x", 1), (None, 2, None, "y", 1), ("s", None, "a", "x", 1)]
    assert changes(spark, data) == [(None, 2, None, "changed", "hash")]


BARS = "source string, ticker string, trade_date date, adj_close double, load_id long, next long, cell double"


def again(spark, data):
    df = spark.createDataFrame([("s", "x", day(d), a, l, 1, 1.0) for d, a, l in data], BARS)
    return rows(redelivered_changes(df, ["source", "ticker", "trade_date"], "load_id", "adj_close", 0.0001), "trade_date", "load_id")


def test_redelivered(spark):
    data = [(0, 1.0, 1), (0, 1.0, 1), (0, 1.00009, 2), (0, 1.00019, 5), (1, 2.0, 1), (2, None, 1), (2, 3.0, 2), (2, 3.0, None)]
    assert again(spark, data) == [(day(0), 5)]
    assert again(spark, []) == []
    assert rows(redelivered_changes(spark.createDataFrame([tuple([None] * 7)], BARS), ["source", "ticker", "trade_date"], "load_id", "adj_close", 0.0001)) == []
