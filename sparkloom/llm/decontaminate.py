"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds a posting (document key, position, term) for every training word that some benchmark text uses. A
window (ten consecutive words of an item) is looked up from its rarest term: that term's postings, moved back by its
offset, are the window's possible starts; the second rarest term's postings are intersected with them, and what is
left is checked against the postings of the other terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import Workspace, fits, row_key, without_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["k1", "k2"]


def words(text: Column) -> Column:
    """The text's words in order; none of a null."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS)
    lead = (F.element_at(parts, 1) == "").cast("int")
    trail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.slice(parts, lead + 1, F.size(parts) - lead - trail)


def _small(df: DataFrame, most_rows: int) -> DataFrame:
    return F.broadcast(df) if fits(df, most_rows) else df


class Index:
    """The postings of one training table for one benchmark.

    ``broadcast_rows`` bounds what is broadcast (benchmark terms and windows, keys of documents that are left); above it
    the joins are shuffled. ``window``: words in a window; an item of fewer words is one window.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, window: int, broadcast_rows: int):
        self.work = Workspace(docs.sparkSession, "decontaminate")
        self.broadcast_rows = broadcast_rows
        text = F.col(text_col).cast("string")
        # Rows are told apart by 96 bits of their id and text; rows that agree in both have the same result.
        k1, k2 = row_key(F.col(id_col), text)
        self.docs = docs.select(F.col(id_col), k1.alias("k1"), k2.alias("k2"), text.alias("_text"))
        items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
        grams = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("gram"))
        grams = self.work.cut(grams.distinct(), "grams")
        self.windows = self.work.cut(grams.select("gram").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
        self.items = grams.join(self.windows, "gram").select("win", "item_id")
        terms = self.windows.select(F.explode("gram").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id())
        self.terms = self.work.cut(terms, "terms")
        # One pass over the texts. A row's first word stands for the row whether the benchmark has it or not, and carries the
        # id and the number of words; a row without words has one posting without position.
        split = self.docs.select(F.col(id_col).alias("id"), *KEY, words(F.col("_text")).alias("w"))
        tokens = split.select("id", *KEY, F.size("w").cast("long").alias("n_words"), F.posexplode_outer("w").alias("pos", "term"))
        heads = F.coalesce(F.col("pos"), F.lit(0)) == 0
        found = tokens.join(_small(self.terms, broadcast_rows), "term", "left").filter(heads | F.col("tid").isNotNull())
        found = found.select(F.when(heads, F.col("id")).alias("id"), *KEY, F.when(heads, F.col("n_words")).alias("n_words"), "pos", "tid")
        log = self.work.cut(found, "postings")
        self.rows = log.filter("n_words is not null").select("id", *KEY, "n_words")
        self.postings = log.filter("tid is not null").select(*KEY, "pos", "tid")
        tf = self.postings.groupBy("tid").agg(F.count("*").alias("tf"))
        spelled = self.windows.select("win", F.size("gram").alias("len"), F.posexplode("gram").alias("off", "term")).join(self.terms, "term").join(tf, "tid")
        by_win = Window.partitionBy("win")
        ranked = spelled.withColumn("found", F.count("*").over(by_win)).filter("found = len")  # else a term occurs nowhere
        self.lists = self.work.cut(ranked.select("win", "len", "off", "tid", F.row_number().over(by_win.orderBy("tf", "off")).alias("rank")), "lists")

    def _ranked(self, rank: int) -> DataFrame:
        return self.lists.filter(F.col("rank") == rank)

    def _starts(self) -> DataFrame:
        """Starts (key, win, len, start) that the windows' rarest terms allow."""
        rarest = _small(self._ranked(1).select("win", "len", "off", "tid"), self.broadcast_rows)
        moved = self.postings.join(rarest, "tid").select(*KEY, "win", "len", (F.col("pos") - F.col("off")).alias("start"))
        return moved.filter("start >= 0")

    def phrases(self) -> DataFrame:
        """Exact matches (key, win, len, start)."""
        starts = self._starts()
        second = self._ranked(2).select("win", "off", F.col("tid").alias("next"))
        lists = self.postings.join(_small(second.select(F.col("next").alias("tid")).distinct(), self.broadcast_rows), "tid", "left_semi")
        asked = starts.filter("len > 1").join(_small(second, self.broadcast_rows), "win").withColumn("pos", F.col("start") + F.col("off"))
        both = asked.join(lists.withColumnRenamed("tid", "next"), [*KEY, "pos", "next"], "left_semi").select(*KEY, "win", "len", "start")
        left = self.work.cut(both.unionByName(starts.filter("len = 1")).distinct(), "left")
        others = self.lists.filter("rank > 2").select("win", "off", "tid")
        keys = left.filter("len > 2").select(*KEY).distinct()
        mine = self.postings.join(_small(keys, self.broadcast_rows), KEY, "left_semi")
        checks = left.filter("len > 2").join(_small(others, self.broadcast_rows), "win").withColumn("pos", F.col("start") + F.col("off"))
        met = checks.join(mine, [*KEY, "pos", "tid"], "left_semi").groupBy(*KEY, "win", "len", "start").agg(F.count("*").alias("met"))
        whole = met.filter("met = len - 2").drop("met")
        return self.work.cut(whole.unionByName(left.filter("len <= 2")), "phrases")

    def proximity(self, slop: int = 10) -> DataFrame:
        """Proximity matches (key, win, at): all distinct terms of the window occur, in any order, at most window length
        plus ``slop`` words from an occurrence of its rarest term, whose position is ``at``."""
        reach = F.col("len") + F.lit(slop)
        anchors = self.postings.join(_small(self._ranked(1).select("win", "len", "tid"), self.broadcast_rows), "tid").select(*KEY, "win", "len", F.col("pos").alias("at")).distinct()
        need = self.lists.select("win", "tid").distinct()
        wanted = need.groupBy("win").agg(F.count("*").alias("terms"))
        asked = anchors.join(_small(need, self.broadcast_rows), "win")
        # Positions meet by blocks of the reach, so that a frequent term is compared with near anchors only.
        block = asked.withColumn("b", F.explode(F.sequence(F.floor((F.col("at") - reach) / 64).cast("int"), F.floor((F.col("at") + reach) / 64).cast("int"))))
        near = block.join(self.postings.withColumn("b", F.floor(F.col("pos") / 64).cast("int")), [*KEY, "tid", "b"]).filter(F.abs(F.col("pos") - F.col("at")) <= reach)
        met = near.select(*KEY, "win", "at", "tid").distinct().groupBy(*KEY, "win", "at").agg(F.count("*").alias("met"))
        return met.join(wanted, "win").filter("met = terms").select(*KEY, "win", "at")

    def report(self) -> DataFrame:
        """Per training row: id, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
        found = self.phrases()
        covered = found.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct()
        hits = covered.groupBy(*KEY).agg(F.count("*").alias("n_hit"))
        named = found.select(*KEY, "win").distinct().join(_small(self.items, self.broadcast_rows), "win").select(*KEY, "item_id").distinct()
        named = named.groupBy(*KEY).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
        found = self.work.cut(hits.join(named, KEY, "left"), "found")
        out = self.rows.join(found, KEY, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        return out.select("id", *KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, slop: int | None = None, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items, contaminated; with ``slop`` also n_near, the windows with
    a proximity match: all their terms in any order, at most window length plus ``slop`` words from their rarest term.

    A word is hit if it lies inside an occurrence of a window. Defined cases: a null text has no words; a benchmark item
    without words or text has no window, one with a null id counts for hits and is in no list of items; several items may
    share a window; repeated rows have equal results; texts are whole, however long; empty tables give an empty result or
    rows without hits. Other columns are left behind, whatever their names.
    """
    index = Index(docs, benchmark, id_col, text_col, window, broadcast_rows)
    out = index.report()
    if slop is not None:
        near = index.proximity(slop).groupBy(*KEY).agg(F.count_distinct("win").alias("n_near"))
        out = out.join(index.work.cut(near, "near"), KEY, "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    return out.drop(*KEY).withColumnRenamed("id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The input's rows, all columns, without those that hold a window of the benchmark.

    Rows are known by their id and text. Defined cases: null, empty and wordless texts stay; repeated rows stay or go together;
    a null id is like any other; columns may have any names; without items all rows stay; an empty table stays empty.
    """
    index = Index(docs, benchmark, id_col, text_col, window, broadcast_rows)
    leaks = index.work.cut(index.phrases().select(*KEY).distinct(), "leaks")
    index.work.drop("postings", "left", "phrases", "lists")
    return without_rows(docs, leaks, id_col, text_col)
