"""Structured Streaming over event logs: counts by window, and a cache kept up to date. An addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """An append-only log of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(events: DataFrame, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(begin, key, n): tumbling counts; state older than ``late`` behind the newest event is dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("begin"), key, "n")


def first_seen(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """One row per key and watermark period: repeated log lines pass once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def keep_cache(events: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends every micro-batch's new keys to a Parquet cache: what the cache holds already is left out, and a batch that
    runs again after a failure adds nothing."""

    def add(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        new = batch.dropDuplicates([key])
        if there:
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti").select(*batch.columns)
        new.write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
