"""Set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking
from .catalogue import twin
from .registry import query


@query("set01_union", "select c_custkey as id, 'customer' as kind from customer union all select s_suppkey, 'supplier' from supplier")
def _(c):
    return c.table("customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")).unionByName(c.table("supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("set02_intersect_except", twin("rk", ", a as (select item from rk where source = 'A' and rank <= 40), b as (select item from rk where source = 'N' and rank <= 40) select 'both' as side, item from (select item from a intersect select item from b) union all select 'first only', item from (select item from a except select item from b)"))
def _(c):
    a, b = (c.rk.filter((F.col("source") == s) & (F.col("rank") <= 40)).select("item") for s in "AN")
    return a.intersect(b).select(F.lit("both").alias("side"), "item").unionByName(a.subtract(b).select(F.lit("first only").alias("side"), "item"))


@query("set03_distinct_keep_first", "select p_name, p_partkey as first_id, p_brand from (select *, row_number() over (partition by p_name order by p_partkey) as r from part) where r = 1")
def _(c):
    return ranking.first_by(c.table("part"), ["p_name"], ["p_partkey"]).select("p_name", F.col("p_partkey").alias("first_id"), "p_brand")


@query("set04_unduplicated_only", "select p_partkey from (select p_partkey, count(*) over (partition by p_brand, p_name, p_type) as n from part) where n = 1")
def _(c):
    return c.table("part").withColumn("n", F.count("*").over(Window.partitionBy("p_brand", "p_name", "p_type"))).filter("n = 1").select("p_partkey")


@query("set05_array_sets", twin("tok", """, a as (select item, list_sort(list(token)) as s from tok group by 1), r as (select list_sort(list(distinct token)) as r from tok where token like 'red%')
select item, len(list_intersect(s, r)) as n_common, len(list_distinct(list_concat(s, r))) as n_all, len(list_filter(s, lambda x: not list_contains(r, x))) as n_only, list_has_all(s, r) as covers, list_has_any(s, r) as meets from a, r"""))
def _(c):
    sets = c.tok.groupBy("item").agg(F.collect_set("token").alias("s"))
    red = F.broadcast(c.tok.filter(F.col("token").startswith("red")).agg(F.collect_set("token").alias("r")))
    return sets.crossJoin(red).select(
        "item", F.size(F.array_intersect("s", "r")).alias("n_common"), F.size(F.array_union("s", "r")).alias("n_all"), F.size(F.array_except("s", "r")).alias("n_only"),
        (F.size(F.array_except("r", "s")) == 0).alias("covers"), F.arrays_overlap("s", "r").alias("meets"))


@query("set06_ordered_dedupe", "with t as (select conv_id, list(role order by turn) as roles from conversations group by 1) select conv_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(roles), lambda r: struct_pack(p := list_position(roles, r), r := r))), lambda s: s.r), '>') as roles from t")
def _(c):
    turns = c.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ">").alias("roles"))


@query("set07_disjoint", "select count(*) filter (where part_ = 'a') as a, count(*) filter (where part_ = 'b') as b, 0 as common from (select case when md5(cast(p_partkey as varchar)) < '8' then 'a' else 'b' end as part_ from part)")
def _(c):
    side = F.when(F.md5(F.col("p_partkey").cast("string")) < "8", "a").otherwise("b")
    rows = c.table("part").select("p_partkey", side.alias("side"))
    a, b = rows.filter("side = 'a'"), rows.filter("side = 'b'")
    common = a.join(b, "p_partkey", "left_semi").agg(F.count("*").cast("int").alias("common"))
    return a.agg(F.count("*").alias("a")).crossJoin(b.agg(F.count("*").alias("b"))).crossJoin(common)
