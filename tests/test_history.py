import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows, stamp
from pitloom.operators.history import ChainStore, Snapshots, plain_words, rebuild_touched, versions
from pitloom.streaming.chains import keep_history

SCHEMA = "ticker string, snapshot_date date, delivered_at timestamp, sector string, is_benchmark boolean, valid_from date, valid_to date, k int, version string, begins int"


def month(n):
    return date(2021 + n // 12, 1 + n % 12, 1)


def make(spark, data):
    return spark.createDataFrame([(*r, 1, "clash", 1) for r in data], SCHEMA)


def row(ticker, n, sector="a", flag=False, start=None, end=None, late=0.0):
    return (ticker, month(n), stamp(31 * n + late), sector, flag, start, end)


def chain(df):
    return rows(df, "ticker", "version", "sector", "valid_from", "valid_to")


def test_words(spark):
    df = spark.createDataFrame([("\tTOLL_Roads. ",), ("--",), (None,)], "s string")
    assert [r[0] for r in df.select(plain_words(F.col("s"))).collect()] == ["toll roads", None, None]


def test_rules(spark):
    start, end = date(2020, 5, 1), date(2021, 3, 15)
    data = [row("x", 0, start=start), row("x", 1, sector=None), row("x", 2, "b"), row("x", 3, "b", end=end), row("x", 5, "b", end=date(2022, 1, 1)), row("x", 6, "b"), row("x", 6, "c", late=-2)]
    assert chain(versions(make(spark, data))) == [("x", 1, "a", start, month(2) - timedelta(days=1)), ("x", 2, "b", month(2), end), ("x", 3, "b", month(6), None)]


def test_null_rows_and_empty(spark):
    assert versions(make(spark, [])).count() == 0
    assert versions(spark.createDataFrame([tuple([None] * 10)], SCHEMA)).count() == 0
    data = [("x", month(0), None, None, None, None, None), ("x", month(1), None, "a", True, None, None), (None, month(1), None, "a", True, None, None)]
    assert chain(versions(make(spark, data))) == [("x", 1, "a", month(0), None)]


def random_rows(seed, n):
    rnd = random.Random(seed)
    return [row(rnd.choice("uvwxyz"), rnd.randrange(14), rnd.choice(["a", "b", None]), rnd.random() < 0.1, rnd.choice([None, month(rnd.randrange(14))]), rnd.choice([None] * 4 + [month(rnd.randrange(14))]), rnd.randrange(9)) for _ in range(n)]


def test_rebuilt_chains_are_those_of_a_full_build(spark):
    old, new = random_rows(1, 60), random_rows(2, 6)
    a, b = make(spark, old), make(spark, new)
    assert chain(rebuild_touched(versions(a), a, b)) == chain(versions(a.unionByName(b)))


def test_store_and_stream(spark, tmp_path):
    store = ChainStore(spark, str(tmp_path / "store"), buckets=3)
    old, new = random_rows(3, 40), random_rows(4, 5)
    store.apply(make(spark, old))
    first = store.state()
    names = Snapshots().names()
    make(spark, new).select(*names).write.parquet(str(tmp_path / "late"))
    stream = spark.readStream.schema(make(spark, []).select(*names).schema).parquet(str(tmp_path / "late"))
    keep_history(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.state()["number"] == first["number"] + 1
    assert chain(store.read()) == chain(versions(make(spark, old + new)))
    keep_history(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    store.apply(make(spark, new), str(tmp_path / "checkpoint"), 0)  # a batch given again
    assert store.state()["number"] == first["number"] + 1 and store.read("raw").count() == 45


def test_store_writes_only_the_buckets_of_a_batch(spark, tmp_path):
    store = ChainStore(spark, f"file://{tmp_path}/store", buckets=8, most_tables=2)
    with pytest.raises(ValueError):
        store.read()
    store.apply(make(spark, []))
    assert store.read().count() == 0
    rows_so_far = random_rows(5, 60)
    store.apply(make(spark, rows_so_far), "w", 1)
    for n in range(2, 6):
        before, late = store.state(), [r for r in random_rows(n, 40) if r[0] == "u"][:3]
        rows_so_far += late
        store.apply(make(spark, [*late, (None, *late[0][1:])]), "w", n)
        after = store.state()
        changed = {b for b in after["history"] if after["history"][b] != before["history"].get(b)}
        assert len(changed) == 1 and chain(store.read()) == chain(versions(make(spark, rows_so_far)))
        assert all(len(t) <= 2 for t in after["raw"].values()) and store.read("raw").count() == len(rows_so_far)
    held = {t for t in after["history"].values()} | {t for ts in after["raw"].values() for t in ts}
    kept = {f"{t.parent.name}/{t.name}" for t in (tmp_path / "store").glob("*/_bucket=*")}
    assert {f"{after['history'][b]}/_bucket={b}" for b in after["history"]} <= kept and len(kept) <= len(after["history"]) + sum(map(len, after["raw"].values())) + len(after["left"])
    assert len(list((tmp_path / "store").glob("pointer-*"))) == 2 and held


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = ChainStore(spark, str(tmp_path / "s")), ChainStore(spark, str(tmp_path / "s"))
    a.apply(make(spark, [row("x", 0)]), "a")
    stale = b.state()
    a.apply(make(spark, [row("x", 1, "b")]), "a", 1)
    with monkeypatch.context() as m:
        m.setattr(b, "state", lambda: stale)
        with pytest.raises(RuntimeError):
            b.apply(make(spark, [row("x", 2, "c")]), "b")
    assert [r[2] for r in chain(a.read())] == ["a", "b"]
    b.apply(make(spark, [row("x", 2, "c")]), "b")
    assert [r[2] for r in chain(a.read())] == ["a", "b", "c"]
