"""Sinks: CSV, one JSON document, resumable appends, relational exports and manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import BOM


def write_csv(df: DataFrame, path: str, bom: bool = False, compression: str | None = None) -> None:
    """CSV with a header and line feeds; with ``bom`` every file starts with a byte-order mark, as spreadsheets want it."""
    df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if bom else df
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").option("escape", '"').option("compression", compression or "none").csv(path)


def write_document(df: DataFrame, path: str, order: str) -> None:
    """All rows as one JSON array in one file, for results that a page loads whole."""
    rows = df.agg(F.sort_array(F.collect_list(F.struct(order, F.struct(*df.columns).alias("row")))).alias("r"))
    rows.select(F.to_json(F.transform("r", lambda x: x["row"])).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def resume(todo: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """What has not been done yet."""
    return todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti")


def append_missing(spark: SparkSession, todo: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Runs ``work`` on the rows whose key is not at ``path`` yet and appends its result there; returns the rows added.

    A restart goes on where the last committed append ended.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    done = spark.read.parquet(path) if there else None
    before = done.count() if there else 0
    work(resume(todo, done, key)).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def bridge(df: DataFrame, key: str, array: str, columns: dict[str, str]) -> DataFrame:
    """A nested array as a table of its own: key, rank from 1, and the elements' fields under new names."""
    rows = df.select(key, F.posexplode(array).alias("_pos", "_e"))
    return rows.select(key, (F.col("_pos") + 1).alias("rank"), *[F.col(f"_e.{a}").alias(b) for a, b in columns.items()])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
