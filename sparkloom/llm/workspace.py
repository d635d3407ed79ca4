"""Shared scratch tables: the durable cuts between the steps of an operator.

A step that several later steps read is written once as Parquet below the folder that the cluster names in
``spark.checkpoint.dir`` and read back. The files are on storage that all executors see, so a lost executor costs
the tasks it was running and nothing that was already written.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local temporary folder only where none is set and all runs in one process
    (tests, notebooks). Elsewhere executors would write to folders of their own and rows would vanish: an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jsc.isDefined():
        return jsc.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    spark.sparkContext.setCheckpointDir(root)
    return shared_root(spark)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(key: Column, text: Column) -> tuple[Column, Column]:
    """96 bits that tell rows apart by their id and text; rows that agree in both have one key."""
    return F.xxhash64(key, text), F.hash(text, key)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (k1, k2). Texts stay where they are if at most ``broadcast_rows``
    keys go; beyond that both sides are shuffled."""
    a, b = unused(docs, "_k1", "_k2")
    one, two = row_key(docs[id_col], docs[text_col].cast("string"))
    gone = gone.select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    side = F.broadcast(gone) if fits(gone, broadcast_rows) else gone
    return docs.withColumns({a: one, b: two}).join(side, [a, b], "left_anti").drop(a, b)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bounds what Python workers get at once, so that very long texts don't add up to very large batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Returns a Python worker's freed memory to the system; workers live on between tasks and operators."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Workspace:
    """One operator run's folder of scratch tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        # A query's shuffle files go when it ends: what later steps need of it has been written by then.
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` and return the written table; everything before it is never computed again."""
        path = f"{self.path}/{table}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """Delete these tables, once no DataFrame built on them will be read any more; without names, the whole folder."""
        for table in tables:
            self._delete(f"{self.path}/{table}")
        if not tables:
            self._delete(self.path)

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, most_rows: int) -> bool:
    """True if ``df`` has at most ``most_rows`` rows; reads no further than that. The check before a broadcast."""
    return df.limit(most_rows + 1).count() <= most_rows
