"""Statistics that the built-in functions lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import average_rank


def subset_lift(feat: DataFrame, subsets: DataFrame, least_items: int, least_support: int) -> DataFrame:
    """How much commoner a feature is in a subset of items than in all: subset, feature, k, p, lift, and its lower bound.

    ``subsets``: distinct (subset, item) rows. Subsets below ``least_items`` and features below ``least_support`` go.
    """
    n = F.broadcast(feat.agg(F.count_distinct("item").cast("double").alias("n")))
    base = feat.groupBy("feature").agg(F.count("*").alias("c")).crossJoin(n).select("feature", (F.col("c") / F.col("n")).alias("p0"))
    sizes = subsets.groupBy("subset").agg(F.count("*").cast("double").alias("m")).filter(F.col("m") >= least_items)
    both = subsets.join(feat.select("item", "feature"), "item").groupBy("subset", "feature").agg(F.count("*").alias("k")).filter(F.col("k") >= least_support)
    p = F.col("k") / F.col("m")
    low = F.greatest(p - 1.96 * F.sqrt(p * (1 - p) / F.col("m")), F.lit(0.0)) / F.col("p0")
    return both.join(sizes, "subset").join(base, "feature").select("subset", "feature", "k", p.alias("p"), (p / F.col("p0")).alias("lift"), low.alias("low"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation with tie-averaged ranks, per group."""
    ranked = average_rank(average_rank(df, x, by, "_x"), y, by, "_y")
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"))


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """P(score of a positive > score of a negative) + half the ties, per group, from average ranks; null without both."""
    ranked = average_rank(df, score, by, "_r")
    pos, n = F.sum(F.col(label).cast("double")), F.count("*")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("_r"))) - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"))


def quadratic_kappa(df: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Quadratic-weighted agreement of two ratings 0..levels-1, in closed form from the contingency table."""
    cells = df.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").cast("double").alias("o"))
    n = cells.agg(F.sum("o").alias("n"))
    ri, cj = cells.groupBy("i").agg(F.sum("o").alias("ri")), cells.groupBy("j").agg(F.sum("o").alias("cj"))
    weight = F.pow(F.col("i") - F.col("j"), 2) / (levels - 1) ** 2
    observed = cells.agg(F.sum(weight * F.col("o")).alias("wo"))
    expected = ri.crossJoin(F.broadcast(cj)).agg(F.sum(weight * F.col("ri") * F.col("cj")).alias("we"))
    return observed.crossJoin(expected).crossJoin(n).select((1 - F.col("wo") / (F.col("we") / F.col("n"))).alias("kappa"))


