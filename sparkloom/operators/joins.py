"""Joins with a stated cardinality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that fails, when it runs, if a key stands on either side more than once.

    The check is part of the plan, a count per key on the join's own partitioning, so it costs no job of its own.
    """
    from pyspark.sql import Window

    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        once = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"a key is repeated on the {side} side")).cast("boolean"))
        return df.withColumn("_once", once).filter("_once").drop("_once")

    return checked(left, "left").join(checked(right, "right"), list(keys), how)
