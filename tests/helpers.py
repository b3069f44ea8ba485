"""Small helpers shared by the tests."""

from datetime import date, datetime, timedelta

D0 = date(2021, 1, 4)  # a Monday


def day(n: int) -> date:
    return D0 + timedelta(days=n)


def stamp(n: float) -> datetime:
    return datetime(2021, 1, 4) + timedelta(days=n)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def all_null(spark, schema: str):
    """One row of nulls."""
    return spark.createDataFrame([tuple([None] * len(schema.split(", ")))], schema)
