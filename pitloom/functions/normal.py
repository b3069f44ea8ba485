"""The normal distribution as expressions: sums and steps of a fixed number, without Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS, STEPS, FAR = 160, 40, 8.0


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))


def cdf(x: Column) -> Column:
    """Share below x: 1/2 plus the density times x + x^3/3 + x^5/15 + ...; 0 and 1 beyond 8 deviations. Null stays null."""
    pair = lambda total, term: F.struct(total.alias("total"), term.alias("term"))
    more = lambda a, k: pair(a["total"] + a["term"] * x * x / (2 * k + 1), a["term"] * x * x / (2 * k + 1))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), pair(x, x), more)["total"]
    return F.when(x > FAR, 1.0).when(x < -FAR, 0.0).otherwise(0.5 + density(x) * series)


def quantile(p: Column) -> Column:
    """The x below which a share p is, by Newton's steps of at most 1; null unless 0 < p < 1."""
    step = lambda z: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (cdf(z) - p) / density(z)))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), lambda z, _: z - step(z))
    return F.when((p > 0) & (p < 1), found)
