"""Expressions with one marker for a missing number: null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is missing, never infinite."""
    return finite(F.try_divide(a, b))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """``x`` within the bounds; null stays null."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    y = x.cast("double")
    return F.when(~F.isnan(y) & (F.abs(y) != float("inf")), y)


def number(text: Column, missing: tuple[str, ...] = (".", "")) -> Column:
    """The number a text holds; null for the given markers and for anything else that is no number."""
    bare = F.trim(text)
    return finite(F.when(~bare.isin(*missing), bare.try_cast("double")))
