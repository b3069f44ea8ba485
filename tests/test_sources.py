import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import day, rows, stamp
from pitloom import pipeline
from pitloom.functions.hashing import content_hash, fixed, row_hash
from pitloom.functions.safe import number
from pitloom.operators.ingest import vintages_from_intervals
from pitloom.sources import bars, http, readers, sinks
from pitloom.sources.snapshots import SnapshotStore, retained

SCHEMA = "ticker string, date date, close double, adj_close double"


def test_content_hash(spark):
    df = spark.createDataFrame([("a", day(i), 1.0 + i, 1.0) for i in range(50)], SCHEMA)
    h = lambda d: content_hash(d, [], [F.col("date"), fixed(F.col("close"), 4)]).first().content_hash
    assert h(df) == h(df.repartition(5, "close")) == h(df.withColumn("close", F.col("close") + 1e-6))
    assert len({h(df), h(df.withColumn("close", F.col("close") + 1e-3)), h(df.limit(49)), h(df.unionByName(df.limit(1))), h(df.where("false"))}) == 5


def test_snapshot_store(spark, tmp_path):
    store = SnapshotStore(str(tmp_path), "ticker", "date", (F.col("date"), fixed(F.col("close"), 4)))
    first = spark.createDataFrame([("a", day(0), 1.0, 1.0), ("b", day(0), 2.0, 1.0)], SCHEMA)
    assert rows(store.write(first, F.lit(stamp(1))), "entity", "status") == [("a", "written"), ("b", "written")]
    assert rows(store.write(first.withColumn("adj_close", F.lit(9.0)), F.lit(stamp(2))), "entity", "status") == [("a", "skipped"), ("b", "skipped")]
    second = spark.createDataFrame([("a", day(0), 1.0, 1.0), ("b", day(0), 3.0, 1.0), ("c", day(1), 4.0, 1.0)], SCHEMA)
    assert rows(store.write(second, F.lit(stamp(3))), "entity", "status") == [("a", "skipped"), ("b", "written"), ("c", "written")]
    assert rows(store.read_latest(spark), "ticker", "close") == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    assert store.manifest(spark).count() == 4
    assert rows(store.missing(spark, spark.createDataFrame([("a",), ("z",), ("z",)], "entity string"))) == [("z",)]


def test_rows_that_differ_hash_differently(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("null", "c"), ("", "c"), ("-", "c"), ("1:a", None), ("1", ":a-")], "x string, y string")
    assert df.select(row_hash(F.col("x"), F.col("y"))).distinct().count() == 8
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1e300,), (1.00001,), (1.00002,)], "x double")
    assert [r[0] for r in odd.select(fixed(F.col("x"), 4)).collect()] == ["NaN", "Infinity", None, "1.0E300", "1.0000", "1.0000"]


def test_content_that_returns_is_not_stored_again(spark, tmp_path):
    store = SnapshotStore(str(tmp_path), ("ticker", "close"), "date", (F.col("adj_close"),))
    a, b = (spark.createDataFrame([("a", day(0), 1.0, x), ("a", day(1), 1.0, x + 1), ("b/c=%", day(0), 2.0, 7.0), (None, day(0), 1.0, 1.0)], SCHEMA) for x in (1.0, 5.0))
    for at, df in enumerate((a, b, a)):
        store.write(df, F.lit(stamp(at)))
    assert rows(store.read_latest(spark), "ticker", "adj_close") == [("a", 1.0), ("a", 2.0), ("b/c=%", 7.0)]
    assert spark.read.parquet(f"{tmp_path}/data").count() == 5 and store.manifest(spark).count() == 4
    # an attempt that ended between data and manifest left its rows: the next one replaces them
    c = spark.createDataFrame([("a", day(0), 1.0, 9.0)], SCHEMA)
    store.write(c, F.lit(stamp(4)))
    kept = store.manifest(spark).where(F.col("written_at") < F.lit(stamp(4))).cache()
    kept.count()
    kept.write.mode("overwrite").parquet(f"{tmp_path}/manifest")
    store.write(c, F.lit(stamp(5)))
    assert rows(store.read_entity(spark, "a", 1.0), "adj_close") == [(9.0,)]
    assert rows(store.read_entity(spark, "none", 1.0)) == []


def test_store_of_nothing(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"), "ticker", "date", (F.col("close"),))
    store.write(spark.createDataFrame([(None, day(0), 1.0, 1.0)], SCHEMA))
    assert store.read_latest(spark).count() == 0 and store.read_latest(spark).columns == ["ticker", "date", "close", "adj_close"]
    store.write(spark.createDataFrame([("a", day(0), 1.0, 1.0)], SCHEMA))
    assert rows(store.read_latest(spark), "ticker") == [("a",)]


def test_retention(spark):
    df = spark.createDataFrame([("a", "p1", day(1), stamp(5)), ("a", "p2", day(2), stamp(1)), ("a", "p3", day(2), stamp(3))], "ticker string, path string, last_date date, written_at timestamp")
    assert rows(retained(df, ["ticker"])) == [("a", "p3")]


def test_versions_and_runs(spark, tmp_path):
    root, df = str(tmp_path / "f"), spark.range(5)
    a = sinks.write_version(df, root, "v1", [F.col("id")])
    assert sinks.write_version(df.repartition(3), root, "v1", [F.col("id")]) == a != sinks.write_version(df, root, "v1", [F.col("id")], force=True)
    b = sinks.write_version(spark.range(6), root, "v1", [F.col("id")])
    assert sinks.read_json(f"{root}/current.json", {})["path"] == b and spark.read.parquet(b).count() == 6
    sinks.write_run(str(tmp_path / "runs/r1"), {"x": 1}, {"t": (df.withColumn("fold", F.col("id") % 2), ["fold"])})
    (tmp_path / "runs/r2").mkdir()
    assert sinks.latest_run(str(tmp_path / "runs")) == str(tmp_path / "runs/r1")
    out = sinks.write_report(str(tmp_path / "r.json"), {"a": spark.createDataFrame([("m", "WARN")], "n string, status string"), "b": df.select(F.raise_error(F.lit("no")).alias("x"))})
    assert out["status"] == "WARN" and "error" in json.load(open(tmp_path / "r.json"))["sections"]["b"]


def test_report_counts_rows_it_does_not_show(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") == 99, "FAIL").when(F.col("id") == 98, "WARN").otherwise("PASS").alias("status"))
    out = sinks.write_report(str(tmp_path / "r.json"), {"long": df, "short": df.limit(3)}, most_rows=10)
    assert out == json.load(open(tmp_path / "r.json")) and out["status"] == "FAIL" and out["rows"] == {"long": 100, "short": 3}
    assert [r["id"] for r in out["sections"]["long"]] == [99, 98, *range(8)] and list(out["tables"]) == ["long"]
    assert rows(spark.read.parquet(out["tables"]["long"])) == rows(df)


def test_readers(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t/one"))
    spark.range(1).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "t/two"))
    assert readers.parquet_tree(spark, str(tmp_path / "t/*")).columns == ["id", "more"]
    assert readers.mart(spark, str(tmp_path / "none"), "a int, b int", ["b"]).columns == ["b"]
    (tmp_path / "u.txt").write_text("# names\nspy\nAAPL # one\n\nSPY\n")
    assert rows(readers.name_list(spark, str(tmp_path / "u.txt")).orderBy("position"), "name") == [("AAPL",), ("SPY",)]
    (tmp_path / "tags.json").write_text('{"tags": ["a:b", "a:c", "a:b", "broken"]}')
    assert rows(readers.tag_list(spark, str(tmp_path / "tags.json"))) == [("a", "b"), ("a", "c")]
    (tmp_path / "s.csv").write_text("ticker,valid_to\nx,\ny,2021-01-04\n")
    assert rows(readers.seed(spark, str(tmp_path / "s.csv"), "ticker string, valid_to date")) == [("x", None), ("y", day(0))]


def test_series_registry(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"series": {"rates": [{"id": "A", "title": "a rate"}, {"id": "B"}], "prices": [{"id": 7}]}}')
    (tmp_path / "once.json").write_text('{"series": ["B", "X"]}')
    got = readers.series_registry(spark, str(tmp_path / "s.json"), str(tmp_path / "once.json"))
    assert rows(got) == [(0, "A", "a rate", "rates", "full"), (1, "B", "B", "rates", "latest"), (2, "7", "7", "prices", "full")]
    assert {r.mode for r in readers.series_registry(spark, str(tmp_path / "s.json"), str(tmp_path / "none.json")).collect()} == {"full"}
    (tmp_path / "bad.json").write_text('{"series": {"rates": [{"title": "no id"}]}}')
    for bad in ("bad.json", "once.json"):
        with pytest.raises(ValueError):
            readers.series_registry(spark, str(tmp_path / bad))
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yml").write_text(yaml.safe_dump({"series": {"rates": [{"id": "A"}]}}))
    assert readers.series_registry(spark, str(tmp_path / "s.yml")).count() == 1


def test_fetcher():
    answers = iter([(500, "x"), ConnectionError("gone"), (429, ""), (200, "good"), (404, "no")])

    def transport(address, headers):
        assert headers == {"agent": "me"}
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    f = http.Fetcher(transport, waits=(0, 0, 0), headers=(("agent", "me"),))
    assert f.one("u") == (200, "good", None)
    assert f.one("u") == (404, None, "status 404")  # not tried again
    broken = http.Fetcher(lambda a, h: (503, "later"), waits=(0,))
    assert broken.one("u") == (503, None, "status 503")


def test_fetched_vintages(spark):
    def transport(address, headers):
        if address.endswith("down"):
            raise ConnectionError("gone")
        return 200, json.dumps({"observations": [{"date": "2021-01-01", "realtime_start": "2021-02-01", "realtime_end": "2021-02-28", "value": "."}, {"date": "2021-01-01", "realtime_start": "2021-03-01", "realtime_end": "9999-12-31", "value": "2.5"}]})

    asked = spark.createDataFrame([("s", "http://x/up"), ("t", "http://x/down"), ("n", None)], "series_id string, u string")
    got = http.fetch(asked, "series_id", "u", http.Fetcher(transport, waits=()))
    assert rows(got, "series_id", "status", "error") == [("s", 200, None), ("t", None, "ConnectionError: gone")]
    seen = http.observations(got).withColumn("value", number(F.col("value")))
    assert rows(vintages_from_intervals(seen), "series_id", "vintage_date", "value") == [("s", date(2021, 2, 1), None), ("s", date(2021, 3, 1), 2.5)]


def test_bar_source(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date,open,close\n2021-01-04,1,2\n2021-02-01,3,\n")
    (tmp_path / "y.csv").write_text("date,close\n2021-01-05,9\n")
    bars.register(spark)
    df = spark.read.format("daily_bars").option("end", "2021-01-31").load(str(tmp_path))
    assert rows(df, "ticker", "date", "open", "close") == [("x", "2021-01-04", "1", "2"), ("y", "2021-01-05", None, "9")]
    assert spark.read.format("daily_bars").option("tickers", "y,none").load(str(tmp_path)).count() == 1


def test_pipeline():
    seen = []

    def failing():
        seen.append("b")
        if seen.count("b") < 3:
            raise ValueError("not yet")

    done = pipeline.run({"a": lambda: seen.append("a"), "b": failing}, waits=(0, 0))
    assert [(s.name, s.status, s.tries) for s in done] == [("a", "done", 1), ("b", "done", 3)]
    broken = pipeline.run({"x": lambda: 1 / 0, "y": lambda: None}, waits=(0,))
    assert [(s.name, s.status, s.tries) for s in broken] == [("x", "failed", 2), ("y", "skipped", 0)] and "division" in broken[0].error
