"""Content hashes that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(x: Column, places: int) -> Column:
    """Text of a number with so many decimals, null for a missing one: smaller changes do not show.

    What has no such decimals (NaN, infinities, numbers beyond 38 digits) is given as it is written.
    """
    return F.coalesce(F.round(x, places).try_cast(f"decimal(38,{places})").cast("string"), x.cast("string"))


def row_hash(*parts: Column) -> Column:
    """Hash of a row. Each part stands behind its length, and a missing one is a sign of its own, so that no two rows are alike."""
    framed = [F.when(t.isNull(), "-").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in (p.cast("string") for p in parts)]
    return F.sha2(F.concat(*framed), 256)


def content_hash(df: DataFrame, keys: list[str], parts: list[Column]) -> DataFrame:
    """(keys..., content_hash, n_rows): equal for equal rows in any order, another for any other row or number of rows.

    Row hashes are added up in four 60-bit words, as decimals, so that no list of a group's hashes is ever held and a group
    can be summed in any number of parts.
    """
    h = row_hash(*parts)
    words = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = df.select(*keys, *(w.alias(f"_w{i}") for i, w in enumerate(words))).groupBy(*keys).agg(
        *(F.sum(f"_w{i}").alias(f"_w{i}") for i in range(4)), F.count(F.lit(1)).alias("n_rows")
    )
    return sums.select(*keys, F.sha2(F.concat_ws("|", "n_rows", *(F.col(f"_w{i}") for i in range(4))), 256).alias("content_hash"), "n_rows")
