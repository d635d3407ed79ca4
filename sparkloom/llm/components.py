"""Connected components of links between row nodes, by alternating large and small stars, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node hands its larger (or its smaller) neighbours to the least node next to it.

    ``edges``: one row per link, u < v. The least node is joined back rather than a node's links being collected.
    """
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u").filter((F.col("v") > F.col("u")) if larger else F.lit(True)).select("v", "m")
    if not larger:
        moved = moved.unionByName(least.select(F.col("u").alias("v"), "m"))
    return moved.filter(F.col("v") != F.col("m")).select(F.col("m").alias("u"), "v").distinct()


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, comp) for every node that a link (u, v) names; comp is the component's least node.

    Both steps keep the components and bring the links closer to stars around the least nodes; they end, after about
    log(longest path) rounds, when a round changes nothing. Each round's links are written, so lineage stays short.
    """
    edges = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    edges, last, i = work.cut(edges, f"{name}-0"), None, 0
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == last or now[0] == 0:
            break
        last, i = now, i + 1
        edges = work.cut(_stars(_stars(edges, True), False), f"{name}-{i}")
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())
