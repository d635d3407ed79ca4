"""The domain adapter: catalogue-shaped inputs from the driver's tables.

Suppliers are the catalogue's items. A feature is a brand and type of parts, its strength the supplier's quantity of it
relative to its best; a note is a part name that the supplier sells more than its average of; edges are suppliers in one
order, voted down by returned lines; votes count lines by quarter and by line status; people are distinct customers.
Each DataFrame has a twin in SQL, for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEAT = """feat as (select item, feature, strength from (
  select item, feature, round(100.0 * q / max(q) over (partition by item), 4) as strength from (
    select l_suppkey as item, p_brand || ' ' || p_type as feature, sum(l_quantity) as q from lineitem join part on l_partkey = p_partkey group by 1, 2)) where strength >= 50)"""
TOK = """tok as (select item, token from (
  select item, token, q, avg(q) over (partition by item) as m from (
    select l_suppkey as item, p_name as token, sum(l_quantity) as q from lineitem join part on l_partkey = p_partkey group by 1, 2)) where q >= m)"""
EDGE = """edge as (select a.l_suppkey as src, b.l_suppkey as dst, count(*) filter (where a.l_returnflag <> 'R') as up, count(*) filter (where a.l_returnflag = 'R') as down
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.l_suppkey <> b.l_suppkey group by 1, 2)"""
POP = """pop as (select s_suppkey as item, s_name as name, n_name as brand, r_name as grp, s_acctbal as price, coalesce(people, 0) as people
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  left join (select l_suppkey, count(distinct o_custkey) as people from lineitem join orders on l_orderkey = o_orderkey group by 1) on l_suppkey = s_suppkey)"""
VOTES = """votes as (select l_suppkey as item, count(*) filter (where quarter(l_shipdate) = 1) as q1, count(*) filter (where quarter(l_shipdate) = 2) as q2,
  count(*) filter (where quarter(l_shipdate) = 3) as q3, count(*) filter (where quarter(l_shipdate) = 4) as q4,
  count(*) filter (where l_linestatus = 'O') as day, count(*) filter (where l_linestatus = 'F') as night from lineitem group by 1)"""
REV = """rev as (select l_suppkey as item, l_returnflag as source, round(sum(l_extendedprice), 2) as revenue from lineitem group by 1, 2),
rk as (select item, source, row_number() over (partition by source order by revenue desc, item) as rank from rev)"""
PAIR = """pair as (select u, v, sum(up) as up, sum(down) as down from (select least(src, dst) as u, greatest(src, dst) as v, up, down from edge) group by 1, 2)"""

_ALL = {"feat": FEAT, "tok": TOK, "edge": EDGE, "pop": POP, "votes": VOTES, "rk": REV, "pair": PAIR}


def twin(names: str, body: str) -> str:
    """The oracle's SQL: the named views' definitions before the body, which may go on with further ones."""
    return "with " + ",\n".join(_ALL[n] for n in names.split()) + ("," if body.lstrip()[:1] == "," else "\n") + body.lstrip().removeprefix(",")


class Catalogue:
    """The adapter's DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def frame(self, rows: list[tuple], schema: str) -> DataFrame:
        """A literal of a few rows."""
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def _sold(self) -> DataFrame:
        return self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def feat(self) -> DataFrame:
        q = self._sold.groupBy(F.col("l_suppkey").alias("item"), F.concat_ws(" ", "p_brand", "p_type").alias("feature")).agg(F.sum("l_quantity").alias("q"))
        strength = F.round(F.lit(100.0) * F.col("q") / F.max("q").over(Window.partitionBy("item")), 4)
        return q.select("item", "feature", strength.alias("strength")).filter("strength >= 50")

    @cached_property
    def tok(self) -> DataFrame:
        q = self._sold.groupBy(F.col("l_suppkey").alias("item"), F.col("p_name").alias("token")).agg(F.sum("l_quantity").alias("q"))
        return q.withColumn("m", F.avg("q").over(Window.partitionBy("item"))).filter("q >= m").select("item", "token")

    @cached_property
    def edge(self) -> DataFrame:
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
        a, b = line.alias("a"), line.alias("b")
        met = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.l_suppkey") != F.col("b.l_suppkey")))
        returned = F.col("a.l_returnflag") == "R"
        return met.groupBy(F.col("a.l_suppkey").alias("src"), F.col("b.l_suppkey").alias("dst")).agg(F.count_if(~returned).alias("up"), F.count_if(returned).alias("down"))

    @cached_property
    def pair(self) -> DataFrame:
        """Undirected edges."""
        return self.edge.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("up").alias("up"), F.sum("down").alias("down"))

    @cached_property
    def pop(self) -> DataFrame:
        people = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("o_custkey").alias("people"))
        placed = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return placed.join(people, "s_suppkey", "left").select(
            F.col("s_suppkey").alias("item"), F.col("s_name").alias("name"), F.col("n_name").alias("brand"), F.col("r_name").alias("grp"), F.col("s_acctbal").alias("price"), F.coalesce("people", F.lit(0)).alias("people"))

    @cached_property
    def votes(self) -> DataFrame:
        quarter = F.quarter("l_shipdate")
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("item")).agg(
            *[F.count_if(quarter == i).alias(f"q{i}") for i in (1, 2, 3, 4)], F.count_if(F.col("l_linestatus") == "O").alias("day"), F.count_if(F.col("l_linestatus") == "F").alias("night"))

    @cached_property
    def rev(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("source")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))

    @cached_property
    def rk(self) -> DataFrame:
        """Three rankings: an item's place by revenue within each source."""
        w = Window.partitionBy("source").orderBy(F.desc("revenue"), "item")
        return self.rev.select("item", "source", F.row_number().over(w).alias("rank"))
