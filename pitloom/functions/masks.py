"""Character-class masks of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(text: Column) -> Column:
    """Generalise a text: each run of digits is ``9``, of letters ``a``, of white space ``_``.

    Every other character stands for itself; null stays null and the empty text stays empty.
    """
    out = F.regexp_replace(text, r"\p{L}+", "a")
    out = F.regexp_replace(out, r"[0-9]+", "9")
    return F.regexp_replace(out, r"\s+", "_")


def number_mask(x: Column) -> Column:
    """Generalise a number to its sign, leading digit and the place of its point, as an integer that keeps the order.

    12.5 and 19 have one mask, 2 and 20 have others; 0 is 0, null stays null. Numbers next to a power of ten may be taken for
    either side of it.
    """
    size = F.abs(x)
    power = F.greatest(F.lit(-307), F.least(F.lit(308), F.floor(F.log10(size))))
    digit = F.least(F.lit(10), F.floor(size / F.pow(F.lit(10.0), power)))
    code = ((power + 400) * 16 + digit).cast("int")
    return F.when(x == 0, 0).when(x > 0, code).when(x < 0, -code)
