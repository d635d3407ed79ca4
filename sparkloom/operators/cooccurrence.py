"""Co-occurrence statistics over (item, feature) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def support(feat: DataFrame, name: str = "feature") -> DataFrame:
    """Distinct items per feature."""
    return feat.groupBy(name).agg(F.count_distinct("item").alias("support"))


def feature_pairs(feat: DataFrame) -> DataFrame:
    """Ordered pairs of features of one item: n_both, Jaccard, lift, P(g | f). Needs one row per item and feature."""
    n = feat.agg(F.count_distinct("item").cast("double").alias("n"))
    s = support(feat)
    slim = feat.select("item", "feature")
    pairs = slim.withColumnRenamed("feature", "f").join(slim.withColumnRenamed("feature", "g"), "item").filter("f <> g").groupBy("f", "g").agg(F.count("*").alias("n_both"))
    sf, sg = s.select(F.col("feature").alias("f"), F.col("support").alias("sf")), s.select(F.col("feature").alias("g"), F.col("support").alias("sg"))
    n_both = F.col("n_both")
    return pairs.join(sf, "f").join(sg, "g").crossJoin(F.broadcast(n)).select(
        "f", "g", "n_both", (n_both / (F.col("sf") + F.col("sg") - n_both)).alias("jaccard"), (n_both * F.col("n") / (F.col("sf") * F.col("sg"))).alias("lift"), (n_both / F.col("sf")).alias("p"),
        (F.ln(n_both * F.col("n") / (F.col("sf") * F.col("sg")))).alias("pmi"))
