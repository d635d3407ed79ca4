"""Entity resolution against a catalogue: blocked candidates, a decision per identity, fusion of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranking import row_rank


def identity_key(prefix: str, value: Column) -> Column:
    """A content-made id."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(value), 1, 12))


def blocked_pairs(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """(left_id, name, ...) with the catalogue rows (right_id, catalogue_name) of the same block."""
    return left.join(right, block)


CHANNELS = ("direct", "phonetic", "contains", "llm_direct", "llm_contains")


def channels(pairs: DataFrame) -> DataFrame:
    """Adds a similarity per channel. The name is romanised first; ``llm_name``, where there is one, is a Latin name that a
    model has restored. An empty key is like nothing.

    direct and llm_direct: the sequence ratio of the Latin keys; phonetic: that of the sound keys; contains and llm_contains:
    the shorter length over the longer if one key holds the other.
    """
    named = pairs if "llm_name" in pairs.columns else pairs.withColumn("llm_name", F.lit(""))
    keys = {"_q": tx.latin_key(tx.romanised("name")), "_c": tx.latin_key("catalogue_name"), "_l": tx.latin_key(F.coalesce("llm_name", F.lit(""))), "_qp": tx.phonetic_key("name"), "_cp": tx.phonetic_key("catalogue_name")}
    keyed = named.withColumns(keys)

    def alike(a: str, b: str) -> Column:
        return F.when((F.col(a) != "") & (F.col(b) != ""), tx.ratio(a, b)).otherwise(0.0)

    found = (alike("_q", "_c"), alike("_qp", "_cp"), tx.containment(F.col("_q"), F.col("_c")), alike("_l", "_c"), tx.containment(F.col("_l"), F.col("_c")))
    return keyed.withColumns({n: F.round(x, 6) for n, x in zip(CHANNELS, found, strict=True)}).drop(*keys)


def scored(pairs: DataFrame) -> DataFrame:
    """Adds the channels, score (the best of them) and exact (equal compact keys)."""
    same = tx.compact_key("name") == tx.compact_key("catalogue_name")
    return channels(pairs).withColumn("score", F.greatest(*CHANNELS)).withColumn("exact", same)


def decide(pairs: DataFrame, strong: tuple = (0.90, 0.03), plausible: tuple = (0.84, 0.10), review: float = 0.68) -> DataFrame:
    """(left_id, right_id, score, margin, status, basis): the best candidate; equal scores prefer the higher id.

    An exact name that only one row has, a strong score with some margin, or a plausible one with more is a MATCH; a fair
    score is for review; the rest is NO_MATCH.
    """
    order = [F.desc("score"), F.desc("right_id")]
    ranked = row_rank(pairs, ["left_id"], order, "_r").withColumn("_n", F.count_if("exact").over(Window.partitionBy("left_id")))
    best = ranked.groupBy("left_id").agg(
        F.max(F.when(F.col("_r") == 1, F.col("right_id"))).alias("right_id"), F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("_next"),
        F.max(F.when(F.col("_r") == 1, (F.col("exact") & (F.col("_n") == 1)).cast("int"))).alias("_sole"))
    margin = F.round(F.col("score") - F.coalesce("_next", F.lit(0.0)), 6)
    rows = best.withColumn("margin", margin)
    fits = lambda t: (F.col("score") >= t[0]) & (F.col("margin") >= t[1])
    basis = F.when(F.col("_sole") == 1, "exact").when(fits(strong), "strong").when(fits(plausible), "plausible").when(F.col("score") >= review, "review").otherwise("low")
    status = F.when(basis.isin("exact", "strong", "plausible"), "MATCH").when(basis == "review", "REVIEW").otherwise("NO_MATCH")
    return rows.select("left_id", "right_id", "score", "margin", status.alias("status"), basis.alias("basis"))


def longer_siblings(names: DataFrame, block: str) -> DataFrame:
    """(id, siblings): how many names of the block go on from this one with further words. A base name with many is not
    confirmed by its own match."""
    a = names.select("id", block, "name")
    b = names.select(block, F.col("name").alias("_other")).distinct()
    near = a.join(b, block).filter(F.col("_other").startswith(F.concat(F.col("name"), F.lit(" "))))
    return a.join(near.groupBy("id").agg(F.count("*").alias("siblings")), "id", "left").select("id", F.coalesce("siblings", F.lit(0)).alias("siblings"))


def fused(channels: DataFrame, k: int) -> DataFrame:
    """(channel, q, item, rank) rows to (q, item, score, rank) by reciprocal ranks."""
    s = channels.groupBy("q", "item").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"))
    return row_rank(s, ["q"], [F.desc("score"), "item"])
