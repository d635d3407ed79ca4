"""Runs of equal values in an order: run-length encoding as a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_lengths(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Per group and run: its number from 1, its value and its length."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    run = F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_change", change).withColumn("run", run).groupBy(*by, "run").agg(F.first(value).alias("value"), F.count("*").alias("n"))
