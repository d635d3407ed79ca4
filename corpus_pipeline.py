"""The corpus pipeline: from raw documents to the token ids of clean, unlike ones.

What holds for all stages: rows are known by their id and text together, so rows that share an id are decided apart; a null
text counts as empty; texts are read whole, however long; columns that the documents may have besides are carried
along, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from sparkloom.llm.workspace import Workspace


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: a score of 0.3 or more.

    Null and empty texts are scored like any other; repeated rows score alike and stay or go together; a null id is never
    learnt from; without any label all documents stay.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then the smallest id (nulls last).

    All blank, empty and null texts are one group; of repeated rows one stays.
    """
    return exact_dedup.without_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (nulls last), of each component of texts that share 80 % of their word 5-grams.

    Blank, empty and null texts are like nothing and stay; of repeated rows one stays.
    """
    return ngram_join.without_near_copies(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage: ten words, or a whole shorter item.

    Null, empty and wordless texts have none and stay; repeated rows stay or go together; without items all stay.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, one row per document in its place: doc_id, n_tokens, the digests, round_trip, token_ids.

    Null and empty texts have no tokens; repeated rows give repeated rows.
    """
    import public_tokenizers

    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("decontaminate", without_leaks),
    ("bpe", encoded),
]

#: The classifier and the tokenizer have no SQL form; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
