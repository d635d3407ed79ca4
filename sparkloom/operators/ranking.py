"""Ranking, top-k and calibration over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

By = Sequence[str]


def row_rank(df: DataFrame, by: By, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Adds the row's place within its group; the order should end in an id, so that there are no ties."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_n(df: DataFrame, by: By, order: Sequence[Column | str], n: int, name: str = "rank") -> DataFrame:
    return row_rank(df, by, order, name).filter(F.col(name) <= n)


def first_by(df: DataFrame, by: By, order: Sequence[Column | str]) -> DataFrame:
    """One row per group, the first in an explicit order."""
    return top_n(df, by, order, 1, "_first").drop("_first")


def average_rank(df: DataFrame, value: str, by: By = (), name: str = "avg_rank") -> DataFrame:
    """Ranks from 1 in ascending order; equal values share the mean of their places."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)


def percentile_rank(df: DataFrame, value: str, by: By = (), name: str = "pct") -> DataFrame:
    """Tie-averaged rank over the number of rows in the group."""
    ranked = average_rank(df, value, by, "_r")
    return ranked.withColumn(name, F.col("_r") / F.count("*").over(Window.partitionBy(*by))).drop("_r")


def capped(df: DataFrame, by: By, cap_by: str, order: Sequence[Column | str], cap: int, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of a scan in order that skips a row once ``cap`` rows of its ``cap_by`` have been taken.

    A row is taken iff fewer than ``cap`` rows of its kind stand before it, taken or not, so two row numbers do it.
    """
    kept = row_rank(df, [*by, cap_by], order, "_kind").filter(F.col("_kind") <= cap).drop("_kind")
    return top_n(kept, by, order, k, name)


def ties_at(df: DataFrame, by: By, score: str, order: Sequence[Column | str], k: int) -> DataFrame:
    """Per group, how many rows have the score of the k-th row (of the last one, if there are fewer)."""
    ranked = row_rank(df, by, order, "_r")
    cut = ranked.filter(F.col("_r") <= k).groupBy(*by).agg(F.max_by(score, "_r").alias("_cut"))
    return df.join(cut, list(by)).groupBy(*by).agg(F.count_if(F.col(score) == F.col("_cut")).alias("tie_at_last"))


def min_max(value: str, by: By) -> Column:
    """0 to 1 within the group; 0.5 where all values are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.when(F.col(value).isNotNull(), 0.5))


def z_score(value: str, by: By) -> Column:
    """In population standard deviations from the group's mean; 0 where all values are equal."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 1e-12, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(F.when(F.col(value).isNotNull(), 0.0))


def quartile(df: DataFrame, value: str, name: str = "quartile") -> DataFrame:
    """1 to 4 by right-closed bins between the exact quartiles; equal values share a bin."""
    edges = df.agg(*[F.percentile(value, p).alias(f"_q{i}") for i, p in enumerate((0.25, 0.5, 0.75))])
    v = F.col(value)
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(v <= F.col("_q0"), 1).when(v <= F.col("_q1"), 2).when(v <= F.col("_q2"), 3).otherwise(4)).drop("_q0", "_q1", "_q2")
