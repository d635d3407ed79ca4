"""Entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, resolve
from .catalogue import twin
from .registry import query

_IDS = "select p_brand || '|' || p_name as k, min(p_partkey) as first_id, min(p_size) as best_rank, count(*) as members from part group by 1"


def left(c):
    """Distinct names per brand of small parts, every third with a slip, to be found among the larger ones."""
    p = c.table("part").filter("p_size <= 10").groupBy(F.col("p_brand").alias("block"), "p_name").agg(F.min("p_partkey").alias("left_id"))
    return p.select("block", "left_id", F.when(F.col("left_id") % 3 == 0, F.concat(F.substring("p_name", 2, 100), F.lit("x"))).otherwise(F.col("p_name")).alias("name"))


def right(c):
    return c.table("part").filter("p_size > 10").groupBy(F.col("p_brand").alias("block"), F.col("p_name").alias("catalogue_name")).agg(F.max("p_partkey").alias("right_id"))


@query("ers01_identities", f"with i as ({_IDS}) select 'I_' || substr(md5(k), 1, 12) as identity, first_id, best_rank, members from i")
def _(c):
    rows = c.table("part").groupBy(F.concat_ws("|", "p_brand", "p_name").alias("k")).agg(F.min("p_partkey").alias("first_id"), F.min("p_size").alias("best_rank"), F.count("*").alias("members"))
    return rows.select(F.concat(F.lit("I_"), F.substring(F.md5("k"), 1, 12)).alias("identity"), "first_id", "best_rank", "members")


@query("ers02_match_decision")
def _(c):
    return resolve.decide(resolve.scored(resolve.blocked_pairs(left(c), right(c), "block")))


@query("ers03_longer_siblings", "with n as (select p_partkey as id, p_brand, case when p_partkey % 2 = 0 then split_part(p_name, ' ', 1) else p_name end as name from part) select a.id, count(distinct b.name) as siblings from n a left join n b on a.p_brand = b.p_brand and starts_with(b.name, a.name || ' ') group by 1")
def _(c):
    name = F.when(F.col("p_partkey") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_name"))
    return resolve.longer_siblings(c.table("part").select(F.col("p_partkey").alias("id"), "p_brand", name.alias("name")), "p_brand")


@query("ers04_all_batches", "select count(*) as pairs, count(distinct left_id) as identities from (select p_brand as block, p_name, min(p_partkey) as left_id from part where p_size <= 10 group by 1, 2) l join (select distinct p_brand as block, p_name from part where p_size > 10) r using (block)")
def _(c):
    # No batches and no early stop: every identity meets its whole block.
    pairs = resolve.blocked_pairs(left(c), right(c), "block")
    return pairs.agg(F.count("*").alias("pairs"), F.count_distinct("left_id").alias("identities"))


@query("ers05_fused_selection", twin("rk", ", s as (select item, round(sum(1.0 / (60 + rank)), 8) as score, count(*) as sources from rk where rank <= 60 group by 1) select item, sources, case when rank <= 20 then 'TOP' when rank <= 40 then 'RESERVE' end as tier from (select *, row_number() over (order by score desc, item) as rank from s) where rank <= 40"))
def _(c):
    s = c.rk.filter("rank <= 60").groupBy("item").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 8).alias("score"), F.count("*").alias("sources"))
    best = s.orderBy(F.desc("score"), "item").limit(40).withColumn("all", F.lit(1))
    return ranking.row_rank(best, ["all"], [F.desc("score"), "item"]).select("item", "sources", F.when(F.col("rank") <= 20, "TOP").otherwise("RESERVE").alias("tier"))


@query("ers06_channel_fusion", twin("rk", ", s as (select 0 as q, item, round(sum(1.0 / (20 + rank)), 8) as score from rk group by 2) select q, item, row_number() over (partition by q order by score desc, item) as rank from s"))
def _(c):
    return resolve.fused(c.rk.select(F.lit(0).alias("q"), "item", "rank"), 20).select("q", "item", "rank")


@query("ers07_evidence", "with l as (select p_brand as block, p_name, min(p_partkey) as left_id from part where p_size <= 10 group by 1, 2), r as (select p_brand as block, p_name as n, max(p_partkey) as right_id from part where p_size > 10 group by 1, 2) select left_id, right_id, len(list_filter(string_split(p_name, ' '), lambda t: not list_contains(string_split(n, ' '), t))) as missing, starts_with(n, split_part(p_name, ' ', 1)) as same_start from l join r using (block)")
def _(c):
    l = c.table("part").filter("p_size <= 10").groupBy(F.col("p_brand").alias("block"), "p_name").agg(F.min("p_partkey").alias("left_id"))  # noqa: E741
    pairs = resolve.blocked_pairs(l, right(c), "block")
    missing = F.size(F.array_except(F.split("p_name", " "), F.split("catalogue_name", " ")))
    return pairs.select("left_id", "right_id", missing.alias("missing"), F.col("catalogue_name").startswith(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("same_start"))


@query("ers08_review_queue", "with a as (select n_nationkey, n_name, count(*) as customers from nation join customer on c_nationkey = n_nationkey group by 1, 2) select n_nationkey, n_name, customers, r_name from a join nation using (n_nationkey, n_name) join region on r_regionkey = n_regionkey where customers >= 60")
def _(c):
    n = c.table("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers")).filter("customers >= 60")
    return c.table("nation").join(n, "n_nationkey").join(F.broadcast(c.table("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "customers", "r_name")
