"""Data-quality checks as one table: check, ok, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, bad: Column | None = None) -> DataFrame:
    """A check that holds if no row of ``df`` (or none that is ``bad``) is left."""
    n = F.count("*") if bad is None else F.count_if(bad)
    return df.agg(n.alias("detail")).select(F.lit(name).alias("check"), (F.col("detail") == 0).alias("ok"), "detail")


def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return _row(df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), name)


def references(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    return _row(child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti"), name)


def holds(df: DataFrame, condition: str, name: str) -> DataFrame:
    """The condition is true or unknown for every row, as in a CHECK constraint."""
    return _row(df, name, ~F.coalesce(F.expr(condition), F.lit(True)))


def count_is(df: DataFrame, expected: int, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("detail")).select(F.lit(name).alias("check"), (F.col("detail") == expected).alias("ok"), "detail")


def same_rows(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Equal as multisets."""
    return _row(a.exceptAll(b).unionAll(b.exceptAll(a)), name)


def fits_decimal(column: str, precision: int, scale: int) -> Column:
    """The value is exactly a DECIMAL(precision, scale)."""
    d = F.col(column).try_cast(f"decimal({precision},{scale})")
    return d.isNotNull() & (F.abs(d.cast("double") - F.col(column)) < 10 ** -(scale + 3))


def within(df: DataFrame, value: str, expected: float, tolerance: float, name: str) -> DataFrame:
    """A single measured value is as known before."""
    d = F.abs(F.col(value) - expected)
    return df.select(F.lit(name).alias("check"), (d <= tolerance).alias("ok"), (d > tolerance).cast("long").alias("detail"))


def suite(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
