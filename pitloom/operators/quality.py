"""Contracts compiled to one aggregation, and violation queries whose rows are what is wrong."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitloom.functions.hashing import fixed, row_hash


@dataclass(frozen=True)
class Contract:
    """Columns a table must have, and rules that hold for every row (null counts as kept unless the rule says otherwise)."""

    name: str
    columns: dict[str, str] = field(default_factory=dict)
    rules: dict[str, Column] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    #: Whether a column that is not among ``columns`` is a violation.
    strict: bool = False


def check(df: DataFrame, contract: Contract) -> DataFrame:
    """(contract, rule, violations): one pass for all rules over all rows, one more aggregation for uniqueness.

    Missing columns and wrong types count as one violation each, and so does, in a strict contract, any other column. An empty
    table violates ``not_empty``. Rules on a missing column cannot be planned and raise.
    """
    have = dict(df.dtypes)
    shape = {f"column:{c}": int(have.get(c) != t) for c, t in contract.columns.items()}
    if contract.strict:
        shape["other_columns"] = len(set(have) - set(contract.columns))
    usable = {n: r for n, r in contract.rules.items()}
    counts = [F.count(F.lit(1)).alias("_rows"), *(F.count(F.when(~F.coalesce(r, F.lit(True)), 1)).alias(n) for n, r in usable.items())]
    one = df.agg(*counts)
    cells = [F.struct(F.lit("not_empty").alias("rule"), F.when(F.col("_rows") == 0, 1).otherwise(0).cast("long").alias("violations"))]
    cells += [F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in usable]
    cells += [F.struct(F.lit(n).alias("rule"), F.lit(v).cast("long").alias("violations")) for n, v in shape.items()]
    out = one.select(F.explode(F.array(*cells)).alias("c")).select(F.lit(contract.name).alias("contract"), "c.*")
    if contract.unique:
        twice = duplicates(df, list(contract.unique)).agg(F.count(F.lit(1)).alias("violations"))
        out = out.unionByName(twice.select(F.lit(contract.name).alias("contract"), F.lit("unique").alias("rule"), "violations"))
    return out


def not_null(*names: str) -> dict[str, Column]:
    return {f"not_null:{c}": F.col(c).isNotNull() for c in names}


def between(name: str, low: float, high: float) -> dict[str, Column]:
    return {f"between:{name}": F.col(name).between(low, high)}


def accepted(name: str, values: list) -> dict[str, Column]:
    return {f"accepted:{name}": F.col(name).isin(*values)}


def ohlc_rules() -> dict[str, Column]:
    """Prices positive, high the highest and low the lowest, volume not negative."""
    top, bottom = F.greatest("open", "close", "low"), F.least("open", "close", "high")
    positive = F.least("open", "high", "low", "close") > 0
    return {"positive": positive, "high": F.col("high") >= top, "low": F.col("low") <= bottom, "volume": F.col("volume") >= 0}


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys..., rule): every row that breaks a rule, once a rule."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules.items())))
    return df.select(*keys, F.explode(broken).alias("rule"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n): keys that come more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct non-null keys without a parent."""
    p = parent.select(F.col(parent_key).alias("_p")).distinct()
    k = df.select(F.col(key).alias(key)).where(F.col(key).isNotNull()).distinct()
    return k.join(p, k[key] == p["_p"], "left_anti")


def first_failures(bad: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """(rule, n_rows, examples): how many rows break each rule, and the n least keys among them."""
    key = F.concat_ws(" ", *(F.col(k).cast("string") for k in keys))
    marked = bad.select("rule", key.alias("_k"))
    w = Window.partitionBy("rule").orderBy("_k")
    top = marked.distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy("rule").agg(F.sort_array(F.collect_list("_k")).alias("examples"))
    return marked.groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows")).join(top, "rule")


def check_groups(df: DataFrame, contract: Contract, keys: list[str]) -> DataFrame:
    """(keys..., n_rows, failed, violations): of each group how many rules are broken, and how often in all; one pass."""
    counts = [F.count(F.when(~F.coalesce(r, F.lit(True)), 1)).alias(f"_{i}") for i, r in enumerate(contract.rules.values())]
    each = [F.col(f"_{i}") for i in range(len(counts))]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0).cast("long"))
    return out.select(*keys, "n_rows", add((x > 0).cast("long") for x in each).alias("failed"), add(each).alias("violations"))


def first_violation(df: DataFrame, keys: list[str], date: str, rules: dict[str, Column], n: int = 3) -> DataFrame:
    """(keys..., rule, dates): for each group that breaks a rule the first one in their order, and the n first dates it is broken on.

    Before the rules comes ``duplicate``: a date of which the group has several rows. A null date is a date like any other, and
    null keys are a group.
    """
    names = ["duplicate", *rules]
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(x) for k, x in zip(keys, ks)), F.col(date).alias("_d"), *(F.coalesce(r, F.lit(True)).alias(f"_r{i}") for i, r in enumerate(rules.values(), 1)))
    days = rows.groupBy(*ks, "_d").agg((F.count(F.lit(1)) == 1).alias("_r0"), *(F.min(f"_r{i}").alias(f"_r{i}") for i in range(1, len(names))))
    broken = F.array_compact(F.array(*(F.when(~F.col(f"_r{i}"), F.lit(i)) for i in range(len(names)))))
    bad = days.select(*ks, "_d", F.explode(broken).alias("_r"))
    group = Window.partitionBy(*ks)
    first = bad.withColumn("_first", F.min("_r").over(group)).where("_r = _first").withColumn("_n", F.row_number().over(group.orderBy("_d"))).where(F.col("_n") <= n)
    told = first.groupBy(*ks, "_r").agg(F.array_join(F.sort_array(F.collect_list(F.coalesce(F.col("_d").cast("string"), F.lit("none")))), ",").alias("dates"))
    return told.select(*(F.col(x).alias(k) for k, x in zip(keys, ks)), F.get(F.array(*map(F.lit, names)), F.col("_r")).alias("rule"), "dates")


def bar_rules() -> dict[str, Column]:
    """What a series of daily bars must hold, in the order in which it is told: nothing missing, prices positive, the day's order, volume."""
    prices = ("open", "high", "low", "close")
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*prices, "adj_close", "volume")))
    out = {"missing": known} | {f"positive:{c}": F.col(c) > 0 for c in (*prices, "adj_close")}
    return out | {f"{a}>{b}": F.col(a) <= F.col(b) for a, b in (("low", "open"), ("low", "close"), ("open", "high"), ("close", "high"))} | {"volume": F.col("volume") >= 0}


def bar_events(df: DataFrame) -> DataFrame:
    """(source, ticker, trade_date, idempotency_key): the bars that keep the row contract, each content once.

    The key is source, ticker, date and the hash of the bar's content, prices to six decimals; a bar delivered again has the
    same key, a revised one another.
    """
    rules = [F.length("source") >= 1, F.length("ticker").between(1, 16), F.col("trade_date").isNotNull(), *bar_rules().values()]
    kept = df.where(reduce(lambda a, b: a & b, (F.coalesce(r, F.lit(False)) for r in rules)))
    content = row_hash(*(F.col(c) for c in ("source", "ticker", "trade_date")), *(fixed(F.col(c), 6) for c in ("open", "high", "low", "close", "adj_close")), F.col("volume"))
    return kept.select("source", "ticker", "trade_date", F.concat_ws(":", "source", "ticker", F.col("trade_date").cast("string"), content).alias("idempotency_key")).distinct()


@dataclass(frozen=True)
class Layer:
    """The outcome for one table: pass, fail or skip; rules broken with their counts; or why it could not be checked."""

    name: str
    status: str
    broken: dict[str, int] = field(default_factory=dict)
    error: str = ""
    seconds: float = 0.0


def run_gate(tables: dict[str, Callable[[], DataFrame]], contracts: list[Contract], skip: tuple[str, ...] = ()) -> tuple[list[Layer], int]:
    """Every contract on its table, in order, and the exit code: 0 if none failed. A table that cannot be read or checked fails, with the error."""
    out = []
    for c in contracts:
        if c.name in skip:
            out.append(Layer(c.name, "skip"))
            continue
        began = time.monotonic()
        try:
            broken = {r["rule"]: r["violations"] for r in check(tables[c.name](), c).where("violations > 0").collect()}
        except Exception as e:  # noqa: BLE001 - the other layers are checked all the same
            out.append(Layer(c.name, "fail", error=f"{type(e).__name__}: {e}"[:500], seconds=time.monotonic() - began))
        else:
            out.append(Layer(c.name, "fail" if broken else "pass", broken, seconds=time.monotonic() - began))
    return out, int(any(layer.status == "fail" for layer in out))


def gate(results: DataFrame) -> DataFrame:
    """(contract, failed, passed): how many rules of each contract failed; passed if none."""
    return results.groupBy("contract").agg(F.count(F.when(F.col("violations") > 0, 1)).alias("failed")).withColumn("passed", F.col("failed") == 0)
