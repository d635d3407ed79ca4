"""Rule-based recommendation: understanding a request, searching with a relaxation ladder, and the response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order() -> list:
    return [F.desc("score"), F.desc_nulls_last("people"), F.asc("item")]


def understand(texts: DataFrame, lexicon: DataFrame, avoid_cue: str = "not ") -> DataFrame:
    """(q, text) rows to (q, core, avoid, evidence): features whose surface the text holds; after the cue they are unwanted.

    ``lexicon``: (surface, feature), of a fixed size, broadcast.
    """
    lex = F.broadcast(lexicon)
    met = texts.join(lex, F.contains(F.lower("text"), F.col("surface"))).withColumn("against", F.contains(F.lower("text"), F.concat(F.lit(avoid_cue), F.col("surface"))))
    per = met.groupBy("q").agg(
        F.array_sort(F.collect_set(F.when(~F.col("against"), F.col("feature")))).alias("core"), F.array_sort(F.collect_set(F.when(F.col("against"), F.col("feature")))).alias("avoid"),
        F.array_sort(F.collect_set("surface")).alias("evidence"))
    return per.withColumn("core", F.array_except("core", "avoid"))


def candidates(requests: DataFrame, feat: DataFrame, items: DataFrame, weight: str = "strength") -> DataFrame:
    """(q, item, people, brand, score, met, n_core): items with a wanted feature and no unwanted one."""
    wanted = F.broadcast(requests.select("q", F.explode("core").alias("feature"), F.size("core").alias("n_core")))
    unwanted = F.broadcast(requests.select("q", F.explode("avoid").alias("feature")))
    scored = feat.join(wanted, "feature").groupBy("q", "item", "n_core").agg(F.round(F.sum(weight), 4).alias("score"), F.count("*").alias("met"))
    bad = feat.join(unwanted, "feature").select("q", "item").distinct()
    return scored.join(bad, ["q", "item"], "left_anti").join(items.select("item", "people", "brand"), "item")


#: The ladder's stages: number, label, condition.
STAGES = ((1, "AND", "n_core >= 2 and met = n_core and people >= {least}"), (2, "OR", "people >= {least}"), (3, "OR_ANY", "true"))


def ladder(cand: DataFrame, least: int, min_results: int, k: int, cap: int) -> DataFrame:
    """The first stage that still has ``min_results`` rows after the brand cap (else the last): q, stage, item, rank, score,
    candidate_count and tie_at_last, both before the cap. All stages are made in one pass over the candidates, by windows alone.
    """
    held = F.array_compact(F.array(*[F.when(F.expr(cond.format(least=least)), F.struct(F.lit(n).alias("n"), F.lit(label).alias("stage"))) for n, label, cond in STAGES]))
    staged = cand.select("*", F.explode(held).alias("s")).select("*", "s.n", "s.stage").drop("s")
    stage, query = Window.partitionBy("q", "n"), Window.partitionBy("q")
    ranked = staged.withColumn("_r", F.row_number().over(stage.orderBy(*_order()))).withColumn("candidate_count", F.count("*").over(stage))
    ranked = ranked.withColumn("_kind", F.row_number().over(Window.partitionBy("q", "n", "brand").orderBy(*_order())))
    last = F.max(F.when(F.col("_r") == F.least(F.lit(k), F.col("candidate_count")), F.col("score"))).over(stage)
    tied = ranked.withColumn("_last", last).withColumn("tie_at_last", F.count_if(F.col("score") == F.col("_last")).over(stage))
    top = tied.filter(F.col("_kind") <= cap).withColumn("rank", F.row_number().over(stage.orderBy("_r"))).filter(F.col("rank") <= k)
    enough = F.when(F.count("*").over(stage) >= min_results, F.col("n"))
    chosen = top.withColumn("_enough", enough).withColumn("_choice", F.coalesce(F.min("_enough").over(query), F.max("n").over(query))).filter("n = _choice")
    return chosen.select("q", "stage", "item", "rank", "score", "candidate_count", "tie_at_last")


def softened(cand: DataFrame, soft: DataFrame, weight: Column, penalty: float) -> DataFrame:
    """Scores less ``penalty`` times the strength of softly unwanted features; soft: (q, item, strength)."""
    lost = soft.groupBy("q", "item").agg(F.sum(weight).alias("_lost"))
    return cand.join(lost, ["q", "item"], "left").withColumn("score", F.round(F.col("score") - penalty * F.coalesce("_lost", F.lit(0.0)), 4)).drop("_lost")


def response(found: DataFrame, requests: DataFrame, feat: DataFrame) -> DataFrame:
    """One row per request: status and the results as JSON, matched features by strength."""
    wanted = F.broadcast(requests.select("q", F.explode("core").alias("feature")))
    matched = feat.join(wanted, "feature").join(found.select("q", "item"), ["q", "item"])
    matched = matched.groupBy("q", "item").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("k"), "feature"))), lambda x: x["feature"]).alias("matched"))
    rows = found.join(matched, ["q", "item"]).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score", "matched"))).alias("results"), F.max("stage").alias("stage"))
    status = F.when(F.size("core") == 0, "NO_CONDITION").when(F.col("results").isNull(), "NO_RESULT").otherwise("OK")
    return requests.join(rows, "q", "left").select("q", status.alias("status"), "stage", F.to_json("results").alias("results"))


def category_score(categories: list[Column]) -> Column:
    """The mean of the scores that there are, times the share of categories that have one."""
    n = sum((c.isNotNull().cast("int") for c in categories[1:]), categories[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in categories[1:]), F.coalesce(categories[0], F.lit(0.0)))
    return F.when(n > 0, total / n * n / len(categories)).otherwise(0.0)
