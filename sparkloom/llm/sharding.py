"""Sharding by a keyed permutation of global row numbers.

Rows are numbered 0..N-1 in the order of their id, and a Feistel network with cycle walking permutes the numbers.
The permuted number p gives shard ``p mod shards`` and slot ``p div shards``: both can be computed for any row number
from N and the key alone, shard sizes differ by one at most, and slots have no gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed bijection of 0..n-1, applied to an array of numbers.

    The network works on 2k bits with 4**k >= n, so its domain is less than four times n. A value that falls
    outside 0..n-1 is permuted again until it is inside, which keeps the map a bijection.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = np.array(numbers, dtype=np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> np.uint64(half), out[todo] & low
            for i in range(ROUNDS):
                left, right = right, left ^ (_mix(right, key * 0x10001 + i * 0x9E3779B9) & low)
            out[todo] = (left << np.uint64(half)) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[Column], work: Workspace) -> tuple[DataFrame, int]:
    """Adds ``row_number`` (0..N-1 in the given order), without a single-task window: rows are range partitioned and
    written with their place within the partition; the partitions' sizes, one row each, give the offsets.

    A hot key is spread over partitions: a last sort key tells repeated rows apart. It may differ from run to run,
    and only rows that agree in ``order`` can change places by it. Nulls sort as ``order`` says; an empty table has no
    numbers.
    """
    placed = (
        df.withColumn("_salt", F.monotonically_increasing_id())
        .repartitionByRange(*order, F.col("_salt"))
        .sortWithinPartitions(*order, F.col("_salt"))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_salt")
    )
    placed = work.cut(placed, "placed")
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    if not offsets:
        return placed.withColumn("row_number", F.lit(0).cast("long")).drop("_part", "_place"), 0
    # One row per shuffle partition: bounded by spark.sql.shuffle.partitions, not by the data.
    small = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _offset long"))
    return placed.join(small, "_part").withColumn("row_number", F.col("_place") + F.col("_offset")).drop("_part", "_place", "_offset"), total


def shard(docs: DataFrame, shards: int = 16, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot.

    Defined cases: a null text has size 1 and the checksum of no bytes; a null id sorts first; repeated rows get
    slots of their own; texts are whole, however long; an empty table gives an empty result. Other columns are left behind,
    whatever their names.
    """
    work = Workspace(docs.sparkSession, "shard")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, total = number_rows(slim, [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size")], work)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, key))

    p = F.col("_p")
    return numbered.withColumn("_p", place("row_number")).select(
        id_col, "size", "text_crc32", F.pmod(p, F.lit(shards)).cast("int").alias("shard"), F.floor(p / F.lit(shards)).cast("long").alias("slot")
    )
