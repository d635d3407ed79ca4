"""Deterministic sampling, splits and quotas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_n


def hash_key(id_col: str, seed: int | None = None) -> Column:
    """A seeded order of ids that any engine with MD5 can reproduce."""
    text = F.col(id_col).cast("string")
    return F.md5(text if seed is None else F.concat(text, F.lit(f"/{seed}")))


def hashed_sample(df: DataFrame, id_col: str, n: int, seed: int | None = None) -> DataFrame:
    """n rows in hash order: a top-k, so no task sees more than its partition and k rows meet in one."""
    return df.orderBy(hash_key(id_col, seed), id_col).limit(n)


def hash_split(id_col: str, shares: dict[str, int], seed: int | None = None) -> Column:
    """A named part for every id, by parts in a hundred."""
    bucket = F.conv(F.substring(hash_key(id_col, seed), 1, 6), 16, 10).cast("long") % 100
    part, edge = None, 0
    for name, width in shares.items():
        edge += width
        part = F.when(bucket < edge, name) if part is None else part.when(bucket < edge, name)
    return part


def round_robin(df: DataFrame, by: list[str], id_col: str, n: int) -> DataFrame:
    """Deals every group's rows in hash order to batches 0..n-1."""
    w = Window.partitionBy(*by).orderBy(hash_key(id_col), id_col)
    return df.withColumn("batch", ((F.row_number().over(w) - 1) % n).cast("int"))


def _repair(quota: dict, supply: dict, total: int, floor: int, cap: int) -> dict:
    """Moves single places until the quotas add up: at the largest quota first, names breaking ties."""
    names = sorted(quota)
    while sum(quota.values()) > total:
        able = [n for n in names if quota[n] > min(floor, supply[n])]
        if not able:
            break
        quota[max(able, key=lambda n: quota[n])] -= 1
    while sum(quota.values()) < total:
        able = [n for n in names if quota[n] < min(cap, supply[n])]
        if not able:
            break
        quota[max(able, key=lambda n: quota[n])] += 1
    return quota


def root_quota(supply: dict[str, int], total: int, floor: int = 1, cap: int | None = None) -> dict[str, int]:
    """Places in proportion to the square root of supply, at least ``floor``, at most ``cap`` and the supply."""
    cap = total if cap is None else cap
    mass = sum(n**0.5 for n in supply.values()) or 1.0
    quota = {k: min(n, cap, max(floor, round(total * n**0.5 / mass))) for k, n in supply.items()}
    return _repair(quota, supply, total, floor, cap)


def water_level_quota(supply: dict[str, int], total: int, cap: int | None = None) -> dict[str, int]:
    """As even as supply and cap allow: a common level, with single places left over going by name."""
    room = {k: min(n, cap) if cap else n for k, n in supply.items()}
    quota, left = dict.fromkeys(room, 0), min(total, sum(room.values()))
    while left:
        open_ = sorted(k for k in room if quota[k] < room[k])
        each = max(1, left // len(open_))
        for k in open_:
            step = min(each, room[k] - quota[k], left)
            quota[k] += step
            left -= step
    return quota


def select_by_quota(df: DataFrame, by: str, order: list, quota: dict[str, int]) -> DataFrame:
    """The first rows of each group up to its quota. Quotas are per group name: a few dozen rows, broadcast."""
    places = df.sparkSession.createDataFrame(pd.DataFrame(sorted(quota.items()), columns=[by, "_places"]))
    ranked = top_n(df, [by], order, max(quota.values(), default=0), "_place")
    return ranked.join(F.broadcast(places), by).filter("_place <= _places").drop("_place", "_places")


def group_supply(df: DataFrame, by: str) -> dict[str, int]:
    """Rows per group name, on the driver: for columns of few distinct values."""
    return {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}
