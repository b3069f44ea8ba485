"""Exact ranks and quantiles of groups of any size.

A group's values are counted first. A group with more distinct values than fit one task is cut at approximate quantiles into
buckets, and these again if they are too large; running counts are taken within a bucket and the counts of the buckets before
are added, so the result is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitloom.session import cut as written

HOT = 2_000_000
#: Parts of one cut, and how often parts are cut again: room for HOT * 1000 ** 3 values a group.
MOST_BUCKETS = 1000
MOST_CUTS = 3


def null_safe(a: str, b: str, keys: list[str]) -> Column:
    """Join condition of two aliased tables: equal keys, null being one."""
    return reduce(lambda p, q: p & q, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def bucket_edges(df: DataFrame, keys: list[str], value: str, hot_rows: int = HOT) -> DataFrame | None:
    """(keys..., _edges) of the groups of more than ``hot_rows`` rows, or None if there are none.

    Edges are approximate quantiles that cut a group into parts of about ``hot_rows``, a thousand parts at most; an edge may
    come several times. Nothing is brought to the driver, and the joins are left to the planner: the table has a row for
    each hot group, and a hot group's rows are a skewed partition that adaptive execution splits.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > hot_rows)
    if not sizes.take(1):
        return None
    parts = F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("_size") / hot_rows)).cast("int")
    hot = sizes.select(*keys, parts.alias("_parts"))
    at = [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)]
    picked = df.alias("c").join(hot.alias("h"), null_safe("c", "h", keys)).select(*(F.col(f"c.{k}") for k in keys), F.col(f"c.{value}").cast("double").alias("_v"), "h._parts")
    cut = picked.groupBy(*keys).agg(F.percentile_approx("_v", at, 10_000).alias("_q"), F.max("_parts").alias("_parts"))
    places = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.element_at("_q", F.floor(i * MOST_BUCKETS / F.col("_parts")).cast("int")))
    return written(cut.select(*keys, places.alias("_edges")))  # the edges must be the same wherever they are used


def running(counts: DataFrame, keys: list[str], value: str, sums: list[str], hot_rows: int = HOT, cuts: int = MOST_CUTS) -> DataFrame:
    """``counts`` (one row per keys and value) with before_<c> and all_<c> of each column in ``sums``.

    before_<c> adds up c over the smaller values of the group, all_<c> over the whole group. Null keys are a group.
    """
    if not keys:
        return running(counts.withColumn("_all", F.lit(0)), ["_all"], value, sums, hot_rows, cuts).drop("_all")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(*keys)
    edges = bucket_edges(counts, keys, value, hot_rows) if cuts else None
    if edges is None:
        order = whole.orderBy(value)
        return counts.select("*", *(before(order, c).alias(f"before_{c}") for c in sums), *(F.sum(c).over(whole).alias(f"all_{c}") for c in sums))
    held = counts.alias("c").join(edges.alias("h"), null_safe("c", "h", keys), "left").select("c.*", "h._edges")
    bucket = f"_bucket{cuts}"
    split = held.withColumn(bucket, F.when(F.col("_edges").isNull(), 0).otherwise(F.size(F.filter("_edges", lambda e: e < F.col(value).cast("double"))))).drop("_edges")
    buckets = split.groupBy(*keys, bucket).agg(*(F.sum(c).alias(f"_b_{c}") for c in sums))
    offsets = buckets.select(*keys, bucket, *(before(whole.orderBy(bucket), f"_b_{c}").alias(f"_o_{c}") for c in sums), *(F.sum(f"_b_{c}").over(whole).alias(f"_w_{c}") for c in sums))
    ranked = running(split, [*keys, bucket], value, sums, hot_rows, cuts - 1)
    joined = ranked.alias("r").join(offsets.alias("o"), null_safe("r", "o", [*keys, bucket]))
    return joined.select(*(f"r.{c}" for c in counts.columns), *((F.col(f"r.before_{c}") + F.col(f"o._o_{c}")).alias(f"before_{c}") for c in sums), *(F.col(f"o._w_{c}").alias(f"all_{c}") for c in sums))


def all_small(df: DataFrame, keys: list[str], hot_rows: int = HOT) -> bool:
    """Whether no group has more than ``hot_rows`` rows: one count over ``keys``, meant for a plain scan."""
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).take(1)


def percentile_ranks(df: DataFrame, keys: list[str], value: str, out: str, hot_rows: int = HOT, small: bool = False) -> DataFrame:
    """``df`` with ``out``: rank of the value in its group over the group's number of values, ties at their mean rank.

    Null values get null and do not count; so do rows with a null key. A caller that knows its groups to be ``small`` (see
    all_small) gets them ranked where they are sorted, without a second look at ``df``.
    """
    if small:
        here = [F.col(k).isNotNull() for k in keys]
        rated = F.when(reduce(lambda a, b: a & b, here, F.lit(True)), F.col(value))
        whole, equal = Window.partitionBy(*keys), Window.partitionBy(*keys, "_value")
        marked = df.withColumn("_value", rated).select("*", F.rank().over(whole.orderBy(F.col("_value").asc_nulls_last())).alias("_rank"), F.count("_value").over(whole).alias("_all"))
        share = (F.col("_rank") + (F.count(F.lit(1)).over(equal) - 1) / 2) / F.col("_all")
        return marked.withColumn(out, F.when(F.col("_value").isNotNull(), share)).select(*df.columns, out)
    known = df.where(F.col(value).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, keys, value, ["_n"], hot_rows)
    share = ranked.select(*keys, value, ((F.col("before__n") + (F.col("_n") + 1) / 2) / F.col("all__n")).alias(out))
    return df.join(share, [*keys, value], "left").select(*df.columns, out)


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], hot_rows: int = HOT) -> DataFrame:
    """(keys..., quantiles, n): exact quantiles of each group by linear interpolation; null values do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return quantiles_of_counts(counts, keys, value, at, hot_rows)


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, at: list[float], hot_rows: int = HOT) -> DataFrame:
    """As quantiles, of (keys..., value, _n): each value once, with how often it comes."""
    r = running(counts, keys, value, ["_n"], hot_rows)
    spots = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("all__n") - 1)).alias("p")) for i, p in enumerate(at)))
    low, high = F.col("before__n"), F.col("before__n") + F.col("_n") - 1

    def part(s):
        """What this value adds to the quantile at position p: its share of the two neighbours of p."""
        f = F.floor(s["p"])
        w = s["p"] - f
        inside = lambda k: (k >= low) & (k <= high)
        return F.when(inside(f), 1 - w).otherwise(0.0) + F.when(inside(f + 1) & (w > 0), w).otherwise(0.0)

    touched = F.filter(F.transform(spots, lambda s: F.struct(s["i"].alias("i"), part(s).alias("w"))), lambda s: s["w"] > 0)
    pieces = r.select(*keys, F.col(value).cast("double").alias("_v"), F.col("all__n").alias("n"), F.explode(touched).alias("s"))
    one = pieces.groupBy(*keys, "s.i").agg(F.sum(F.col("_v") * F.col("s.w")).alias("q"), F.max("n").alias("n"))
    return one.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("quantiles"), F.max("n").alias("n"))
