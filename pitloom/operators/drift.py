"""Drift between two windows of a table, freshness, and means of the last results."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitloom.operators.ranks import quantiles_of_counts, running
from pitloom.session import cut

EPS = 1e-6


def windows(df: DataFrame, date: str, n_ref: int, n_cur: int) -> DataFrame:
    """Rows of the first n_ref and of the last n_cur distinct dates, marked ``part`` = ref or cur; the dates are ranked alone.

    A table of fewer than n_ref + n_cur dates gives no rows.
    """
    dates = df.select(F.col(date).alias("_d")).where("_d IS NOT NULL").distinct()
    # one row a calendar date
    ranked = dates.select("_d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_d")).alias("_k"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("_n"))
    part = F.when(F.col("_k") <= n_ref, "ref").when(F.col("_k") > F.col("_n") - n_cur, "cur")
    chosen = ranked.where(F.col("_n") >= n_ref + n_cur).select("_d", part.alias("part")).where("part IS NOT NULL")
    return df.join(chosen, df[date] == chosen["_d"]).select(*(df[c] for c in df.columns), "part")


def long_features(df: DataFrame, features: list[str]) -> DataFrame:
    """(part, feature, x): the finite values, all features in one pass."""
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))
    return df.select("part", F.explode(cells).alias("c")).select("part", "c.*").where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')")


def counted(long: DataFrame) -> DataFrame:
    """(feature, x, r, c): how often each value comes in the reference and in the current window; all that the figures need."""
    side = lambda part: F.sum(F.when(F.col("part") == part, 1).otherwise(0))
    return long.groupBy("feature", "x").agg(side("ref").alias("r"), side("cur").alias("c"))


def psi(counts: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, n_ref, n_cur, psi) of ``counted``: population stability index over the reference's quantile bins, outer bins open.

    Bins are closed on the left, equal edges count once, a share below a millionth counts as that. Null with fewer than two
    inner or outer bins or fewer than two values on a side.
    """
    at = [i / bins for i in range(bins + 1)]
    reference = counts.where("r > 0").select("feature", "x", F.col("r").alias("_n"))
    edges = quantiles_of_counts(reference, ["feature"], "x", at).select("feature", F.array_distinct("quantiles").alias("edges"))
    x = F.col("x")
    inner = F.slice("edges", 2, F.size("edges") - 2)
    binned = counts.join(edges, "feature").where(F.size("edges") >= 3).select("feature", "r", "c", F.size(F.filter(inner, lambda e: e <= x)).alias("bin"))
    sides = binned.groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    sizes = counts.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    # the bins of the reference that hold nothing of either side cannot be told from the counts: they add nothing
    share = lambda k, n: F.greatest(F.col(k) / F.col(n), F.lit(EPS))
    r, c = share("r", "nr"), share("c", "nc")
    total = sides.join(sizes, "feature").where("nr >= 2 AND nc >= 2").groupBy("feature").agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))
    return sizes.select("feature", F.col("nr").alias("n_ref"), F.col("nc").alias("n_cur")).join(total, "feature", "left")


def ks(counts: DataFrame) -> DataFrame:
    """(feature, ks_stat, n_ref, n_cur) of ``counted``: largest distance of the two distribution functions; null below two values a side."""
    cum = running(counts, ["feature"], "x", ["r", "c"])
    gap = F.abs(F.try_divide(F.col("before_r") + F.col("r"), F.col("all_r")) - F.try_divide(F.col("before_c") + F.col("c"), F.col("all_c")))
    out = cum.groupBy("feature").agg(F.max(gap).alias("ks_stat"), F.max("all_r").alias("n_ref"), F.max("all_c").alias("n_cur"))
    return out.withColumn("ks_stat", F.when((F.col("n_ref") >= 2) & (F.col("n_cur") >= 2), F.col("ks_stat")))


def ks_p_value(stat: Column, n_ref: Column, n_cur: Column, terms: int = 100) -> Column:
    """Two-sided p of the statistic by Kolmogorov's series, with the usual correction of the effective size."""
    en = F.sqrt(n_ref * n_cur / (n_ref + n_cur))
    lam = (en + 0.12 + 0.11 / en) * stat
    term = lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam * lam)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda total, j: total + term(j))
    return F.when(stat.isNull(), None).when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def severity(psi_value: Column, p: Column, psi_at: tuple[float, float] = (0.10, 0.25), p_at: tuple[float, float] = (0.05, 0.01)) -> Column:
    """PASS, WARN or FAIL: the worse of both; what cannot be measured passes."""
    rank = F.greatest(
        F.when(psi_value >= psi_at[1], 2).when(psi_value >= psi_at[0], 1).otherwise(0),
        F.when(p <= p_at[1], 2).when(p <= p_at[0], 1).otherwise(0),
    )
    return status(rank)


def status(rank: Column) -> Column:
    return F.when(rank >= 2, "FAIL").when(rank == 1, "WARN").otherwise("PASS")


def drift_report(df: DataFrame, date: str, features: list[str], n_ref: int = 60, n_cur: int = 60) -> DataFrame:
    return drift_of(long_features(windows(df, date, n_ref, n_cur), features))


def drift_of(long: DataFrame, exact_cells: int = 0) -> DataFrame:
    """(feature, n_ref, n_cur, psi, ks_stat, ks_pvalue, status) of each feature of (part, feature, x).

    The p-value is exact where both samples' sizes multiply to ``exact_cells`` at most, else of Kolmogorov's series. The counts
    of the values are written once, and all figures are read off them.
    """
    counts = cut(counted(long))
    both = psi(counts).join(ks(counts).select("feature", "ks_stat"), "feature", "left")
    if exact_cells:
        both = both.withColumn("_exact", _exact_p("ks_stat", "n_ref", "n_cur", F.col("n_ref") * F.col("n_cur") <= exact_cells))
    else:
        both = both.withColumn("_exact", F.lit(None).cast("double"))
    p = F.coalesce("_exact", ks_p_value(F.col("ks_stat"), F.col("n_ref"), F.col("n_cur")))
    return both.withColumn("ks_pvalue", p).withColumn("status", severity(F.col("psi"), F.col("ks_pvalue"))).drop("_exact")


def _exact_p(stat: str, n: str, m: str, where: Column) -> Column:
    """exact_ks_p of a feature's row, null where not asked for."""

    @F.pandas_udf("double")
    def run(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else exact_ks_p(x, int(i), int(j)) for x, i, j in zip(d, a, b)], dtype="float64")

    return run(F.when(where, F.col(stat)), F.col(n), F.col(m))


def freshness(tables: dict[str, tuple[DataFrame, str, int, int]], reference: Column) -> DataFrame:
    """(mart, latest, age_days, status) for each name: table, date column, ages from which it is WARN and FAIL; none: FAIL."""
    out = None
    for name, (df, date, warn, fail) in tables.items():
        age = F.date_diff(reference, F.col("latest"))
        one = df.agg(F.max(date).cast("date").alias("latest")).select(
            F.lit(name).alias("mart"), "latest", age.alias("age_days"), F.when(age.isNull() | (age >= fail), "FAIL").when(age >= warn, "WARN").otherwise("PASS").alias("status")
        )
        out = one if out is None else out.unionByName(one)
    return out


def tail_mean(df: DataFrame, keys: list[str], order: str, metrics: list[str], k: int) -> DataFrame:
    """(keys..., metric, mean): mean of each metric's last k values that are not null."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))
    long = df.select(*keys, order, F.explode(cells).alias("c")).select(*keys, order, "c.*").where("x IS NOT NULL")
    w = Window.partitionBy(*keys, "metric").orderBy(F.col(order).desc())
    return long.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).groupBy(*keys, "metric").agg(F.avg("x").alias("mean"))


@dataclass(frozen=True)
class Threshold:
    """Values from which a metric is WARN and FAIL: at or below them, or at or above if ``lower_is_better``."""

    warn: float
    fail: float
    lower_is_better: bool = False


#: Fixed values of the tracked metrics.
TRACKED = {
    "log_loss": Threshold(0.72, 0.75, True),
    "brier": Threshold(0.26, 0.28, True),
    "auc": Threshold(0.50, 0.48),
    "sharpe": Threshold(0.00, -0.50),
}


def performance(df: DataFrame, keys: list[str], order: str, k: int = 4, tracked: dict[str, Threshold] = TRACKED) -> DataFrame:
    """(keys..., metric, mean, status): mean of each tracked metric's last k values against its thresholds.

    A metric without any value passes; metrics that the table lacks are left out.
    """
    names = [m for m in tracked if m in df.columns]
    groups = df.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, names))).alias("metric"))
    means = groups.join(tail_mean(df, keys, order, names, k), [*keys, "metric"], "left")

    def rank(m: str) -> Column:
        t, x = tracked[m], F.col("mean")
        beyond = (lambda v: x >= v) if t.lower_is_better else (lambda v: x <= v)
        return F.when((F.col("metric") == m) & x.isNotNull(), F.when(beyond(t.fail), 2).when(beyond(t.warn), 1))

    return means.withColumn("status", status(F.coalesce(*(rank(m) for m in names), F.lit(0))))


def worst_first(df: DataFrame, n: int, ties: list[str]) -> DataFrame:
    """The n worst rows of a drift table: by status, then the greatest psi, nulls last."""
    order = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    return df.orderBy(order.desc(), F.col("psi").desc_nulls_last(), *ties).limit(n)


def overall(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., status): the worst status of each group, PASS if none is known."""
    rank = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return df.groupBy(*keys).agg(rank.alias("_rank")).select(*keys, status(F.col("_rank")).alias("status"))


def exact_ks_p(stat: float, n: int, m: int) -> float:
    """Two-sided p of D for small samples by counting lattice paths; for reports of few features, on the driver."""
    if n < 1 or m < 1 or not math.isfinite(stat):
        return math.nan
    limit = stat * n * m - 1e-9 * n * m
    row: Sequence[float] = [1.0 if abs(j * n) < limit else 0.0 for j in range(m + 1)]
    for j in range(1, m + 1):
        row[j] = row[j - 1] if abs(j * n) < limit else 0.0
    for i in range(1, n + 1):
        new = [0.0] * (m + 1)
        for j in range(m + 1):
            if abs(i * m - j * n) >= limit:
                continue
            up = row[j] * i / (i + j) if i + j else 1.0
            side = new[j - 1] * j / (i + j) if j else 0.0
            new[j] = up + side
        row = new
    return min(1.0, max(0.0, 1.0 - row[m]))
