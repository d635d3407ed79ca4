"""Ridge regression from partition-summed normal equations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import hash_key


def ridge_cv_r2(df: DataFrame, id_col: str, folds: int, ridge: float) -> DataFrame:
    """(fold, r2) of y on the array x, folds by hash of the id. One aggregation gives every fold's moments, and the
    driver solves systems of the features' number."""
    width = df.select(F.size("x").alias("n")).first()["n"]
    fold = (F.conv(F.substring(hash_key(id_col), 1, 6), 16, 10).cast("long") % folds).cast("int")
    v = F.array_append(F.concat(F.array(F.lit(1.0)), F.col("x")), F.col("y"))
    rows = df.select(fold.alias("fold"), v.alias("v"))
    sums = rows.groupBy("fold").agg(*[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"m{i}_{j}") for i in range(width + 2) for j in range(width + 2)]).collect()
    moments = {r["fold"]: np.array([[r[f"m{i}_{j}"] for j in range(width + 2)] for i in range(width + 2)]) for r in sums}
    out = []
    for f, held in sorted(moments.items()):
        fit = sum((m for g, m in moments.items() if g != f), np.zeros_like(held))
        penalty = ridge * np.eye(width + 1)
        penalty[0, 0] = 0
        beta = np.linalg.solve(fit[:-1, :-1] + penalty, fit[:-1, -1])
        full = np.append(beta, -1.0)
        total = held[-1, -1] - held[0, -1] ** 2 / held[0, 0]
        out.append((int(f), round(float(1 - full @ held @ full / total), 6) if total > 0 else None))
    return df.sparkSession.createDataFrame(out, "fold int, r2 double")
