"""Retrieval evaluation over ranked lists (q, item, rank) and relevance (q, item[, gain])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevant_pairs(edges: DataFrame) -> DataFrame:
    """Relevance from undirected pairs (u, v), from either side."""
    return edges.select(F.col("u").alias("q"), F.col("v").alias("item")).unionByName(edges.select(F.col("v").alias("q"), F.col("u").alias("item")))


def _discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def ideal_dcg(n: Column) -> Column:
    """DCG of n relevant items on top."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))).otherwise(0.0)


def metrics(ranked: DataFrame, relevant: DataFrame, ks: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., q, k, recall, precision, hit, mrr, ndcg) for every query with a relevant item."""
    sizes = relevant.groupBy("q").agg(F.count("*").alias("n_rel"))
    queries = ranked.select(*by, "q").distinct().join(sizes, "q")
    hits = ranked.join(relevant.select("q", "item"), ["q", "item"]).select(*by, "q", "rank")
    cuts = F.explode(F.array(*map(F.lit, ks))).alias("k")
    rows = queries.join(hits, [*by, "q"], "left").select(*by, "q", "n_rel", "rank", cuts)
    inside = F.col("rank") <= F.col("k")
    found = F.count_if(inside)
    return rows.groupBy(*by, "q", "k", "n_rel").agg(
        found.alias("found"), F.coalesce(F.max(F.when(inside, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"), F.coalesce(F.sum(F.when(inside, _discount(F.col("rank")))), F.lit(0.0)).alias("dcg")
    ).select(*by, "q", "k", (F.col("found") / F.col("n_rel")).alias("recall"), (F.col("found") / F.col("k")).alias("precision"), (F.col("found") > 0).cast("int").alias("hit"), "mrr", (F.col("dcg") / ideal_dcg(F.least("n_rel", "k"))).alias("ndcg"))


def graded_ndcg(ranked: DataFrame, gains: DataFrame, k: int, best: int) -> DataFrame:
    """(q, ndcg) with gains 2**g - 1 against k items of the best grade."""
    ideal = sum(1.0 / __import__("math").log2(i + 1) for i in range(1, k + 1)) * (2**best - 1)
    rows = ranked.filter(F.col("rank") <= k).join(gains, ["q", "item"], "left")
    gain = F.coalesce(F.pow(F.lit(2.0), F.col("gain")) - 1, F.lit(0.0)) * _discount(F.col("rank"))
    return rows.groupBy("q").agg((F.sum(gain) / ideal).alias("ndcg"))


def linear_ndcg(ranked: DataFrame, gains: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(q, ndcg): linear gains against k items that meet all n_wanted conditions."""
    rows = ranked.filter(F.col("rank") <= k).join(gains, ["q", "item"], "left").join(wanted, "q")
    share = F.sum(F.coalesce("gain", F.lit(0)) * _discount(F.col("rank"))) / (F.max("n_wanted") * ideal_dcg(F.lit(k)))
    return rows.groupBy("q").agg(share.alias("ndcg"))


def pooled_ndcg(ranked: DataFrame, ratings: DataFrame, k: int) -> DataFrame:
    """(q, ndcg): the ideal order is that of all ratings pooled for the query."""
    pool = ratings.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("gain"), asc=False), 1, k).alias("best"))
    ideal = F.aggregate(F.transform("best", lambda g, i: g.cast("double") / F.log2(i + 2)), F.lit(0.0), lambda s, v: s + v)
    got = ranked.filter(F.col("rank") <= k).join(ratings, ["q", "item"], "left").groupBy("q").agg(F.sum(F.coalesce("gain", F.lit(0)) * _discount(F.col("rank"))).alias("dcg"))
    return got.join(pool, "q").select("q", F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def fold_summary(rows: DataFrame, fold: str, value: str, by: list[str]) -> DataFrame:
    """Means per fold, then their mean and sample standard deviation."""
    folds = rows.groupBy(*by, fold).agg(F.avg(value).alias("m"))
    return folds.groupBy(*by).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))


def paired_bootstrap(diffs: DataFrame, resamples: int, seed: int = 1) -> DataFrame:
    """(diffs: id, diff) mean, 2.5 and 97.5 percent points of resampled means, and the share of means above 0.

    Each row's count in each resample is Poisson with mean 1, drawn from a hash of row and resample: rows never meet, and
    every resample's mean is one group of an aggregation.
    """
    b = diffs.sparkSession.range(resamples).select(F.col("id").alias("b"))
    u = F.pmod(F.xxhash64("id", "b", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    times, edge, p = F.lit(0), 0.0, __import__("math").exp(-1)
    for k in range(1, 9):
        edge += p
        times = times + (u >= edge).cast("int")
        p /= k
    means = diffs.crossJoin(F.broadcast(b)).withColumn("n", times).groupBy("b").agg((F.sum(F.col("n") * F.col("diff")) / F.sum("n")).alias("m"))
    ci = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("p_above"))
    return diffs.agg(F.avg("diff").alias("mean")).crossJoin(ci)


def pareto_front(df: DataFrame, up: list[str]) -> DataFrame:
    """Rows that no other row matches in all measures and beats in one. For tables of candidates, not of data."""
    other = df.select(*[F.col(x).alias(f"_{x}") for x in up])
    as_good = [F.col(f"_{x}") >= F.col(x) for x in up]
    better = [F.col(f"_{x}") > F.col(x) for x in up]
    cond = as_good[0]
    for x in as_good[1:]:
        cond = cond & x
    some = better[0]
    for x in better[1:]:
        some = some | x
    return df.join(F.broadcast(other), cond & some, "left_anti")


def micro_prf(df: DataFrame, gold: str, said: str, by: list[str]) -> DataFrame:
    """Micro precision, recall and F1 over rows of two label arrays; 0 where a denominator is 0."""
    tp, fp, fn = F.size(F.array_intersect(gold, said)), F.size(F.array_except(said, gold)), F.size(F.array_except(gold, said))
    s = df.groupBy(*by).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t, p, n = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(*by, "tp", "fp", "fn", ratio(t, t + p).alias("precision"), ratio(t, t + n).alias("recall"), ratio(2 * t, 2 * t + p + n).alias("f1"))
