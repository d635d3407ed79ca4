"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from .catalogue import twin
from .registry import query


@query("jon01_left_override", twin("pop", ", o as (select s_suppkey as item, case when s_acctbal > 5000 then 1 end as fixed from supplier where s_acctbal > 2000) select pop.item, coalesce(fixed, people) as people from pop left join o on o.item = pop.item"))
def _(c):
    over = c.table("supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("item"), F.when(F.col("s_acctbal") > 5000, F.lit(1).cast("long")).alias("fixed"))
    return c.pop.join(over, "item", "left").select("item", F.coalesce("fixed", "people").alias("people"))


_LIFT = """, n as (select count(distinct item)::double as n from feat), s as (select feature, count(*) as c from feat group by 1), t as (select token, count(*) as c from tok group by 1),
b as (select token, feature, count(*) as n_both from tok join feat using (item) group by 1, 2),
l as (select token, feature, n_both, round(n_both / t.c, 6) as p, round(n_both * n / (t.c * s.c), 6) as lift from b join t using (token) join s using (feature), n)"""


def lift(c):
    """Token and feature together: count, P(feature | token) and lift."""
    n = c.feat.agg(F.count_distinct("item").cast("double").alias("n"))
    s, t = c.feat.groupBy("feature").agg(F.count("*").alias("sc")), c.tok.groupBy("token").agg(F.count("*").alias("tc"))
    n_both = c.tok.join(c.feat, "item").groupBy("token", "feature").agg(F.count("*").alias("n_both"))
    return n_both.join(t, "token").join(s, "feature").crossJoin(F.broadcast(n)).select(
        "token", "feature", "n_both", F.round(F.col("n_both") / F.col("tc"), 6).alias("p"), F.round(F.col("n_both") * F.col("n") / (F.col("tc") * F.col("sc")), 6).alias("lift"))


@query("jon02_bridge_top5_union", twin("feat tok", _LIFT + """, a as (select *, row_number() over (partition by token order by p desc, feature) as rp, row_number() over (partition by token order by lift desc, feature) as rl from l)
select token, feature, case when rp <= 5 and rl <= 5 then 'both' when rp <= 5 then 'P_TOP5' else 'LIFT_TOP5' end as selected_by from a where rp <= 5 or rl <= 5"""))
def _(c):
    pairs = lift(c)
    by_p = ranking.top_n(pairs, ["token"], [F.desc("p"), "feature"], 5, "rp").select("token", "feature", "rp")
    by_lift = ranking.top_n(pairs, ["token"], [F.desc("lift"), "feature"], 5, "rl").select("token", "feature", "rl")
    source = F.when(F.col("rp").isNotNull() & F.col("rl").isNotNull(), "both").when(F.col("rp").isNotNull(), "P_TOP5").otherwise("LIFT_TOP5")
    return by_p.join(by_lift, ["token", "feature"], "full").select("token", "feature", source.alias("selected_by"))


@query("jon03_one_to_one", twin("pop votes", "select pop.item, brand, q1 from pop join votes using (item)"))
def _(c):
    from ..operators.joins import one_to_one

    return one_to_one(c.pop.select("item", "brand"), c.votes.select("item", "q1"), ["item"])


@query("jon04_semi_anti", twin("pop tok", ", s as (select distinct item from tok where token like 'red%') select item, 'in' as side from pop where item in (select item from s) union all select item, 'out' from pop where item not in (select item from s)"))
def _(c):
    s = c.tok.filter(F.col("token").startswith("red"))
    return c.pop.join(s, "item", "left_semi").select("item", F.lit("in").alias("side")).unionByName(c.pop.join(s, "item", "left_anti").select("item", F.lit("out").alias("side")))


@query("jon05_dictionary_lookup", "select p_partkey, coalesce(k, 'other') as kind from part left join (values ('ECONOMY', 'low'), ('LARGE', 'high'), ('PROMO', 'low')) v(t, k) on t = p_type")
def _(c):
    words = c.frame([("ECONOMY", "low"), ("LARGE", "high"), ("PROMO", "low")], "p_type string, k string")
    return c.table("part").join(F.broadcast(words), "p_type", "left").select("p_partkey", F.coalesce("k", F.lit("other")).alias("kind"))


@query("jon06_unique_mapping", "with m as (select p_name, min(p_type) as t from part where p_size = 7 group by 1 having count(distinct p_type) = 1) select p_partkey, t as mapped from part join m using (p_name)")
def _(c):
    part = c.table("part")
    unique = part.filter("p_size = 7").groupBy("p_name").agg(F.count_distinct("p_type").alias("n"), F.min("p_type").alias("mapped")).filter("n = 1")
    return part.join(unique, "p_name").select("p_partkey", "mapped")


_REMAP = "with m as (select distinct p_size % 25 as old, p_size as new from part where p_size <= 40), n as (select *, count(*) over (partition by old) as k from m)"


@query("jon07_id_remap", _REMAP + " select p_partkey, new, k is not null and k > 1 as ambiguous from part left join (select old, min(new) as new_, k, case when k = 1 then min(new) end as new from n group by old, k) on old = p_size % 25")
def _(c):
    part = c.table("part")
    remap = part.filter("p_size <= 40").select((F.col("p_size") % 25).alias("old"), F.col("p_size").alias("new")).distinct()
    whole = remap.groupBy("old").agg(F.count("*").alias("k"), F.min("new").alias("new"))
    return part.withColumn("old", F.col("p_size") % 25).join(F.broadcast(whole), "old", "left").select("p_partkey", F.when(F.col("k") == 1, F.col("new")).alias("new"), F.coalesce(F.col("k") > 1, F.lit(False)).alias("ambiguous"))


@query("jon08_shared_features", twin("feat", "select a.item as a, b.item as b, count(*) as shared, round(sum(least(a.strength, b.strength)), 4) as overlap from feat a join feat b on a.feature = b.feature and a.item < b.item group by 1, 2"))
def _(c):
    from ..operators.blocks import half_up
    from ..operators.similarity import Profiles

    p = Profiles(c.table("lineitem").select("l_suppkey"), c.feat)

    def values(left, right):
        there, n, total = left.shared(right)
        return there, n, half_up(total, 4) / 1e4

    return p.pairs(values, "shared long, overlap double")


@query("jon09_feature_cooccurrence", twin("feat", """, n as (select count(distinct item)::double as n from feat), s as (select feature, count(*) as c from feat group by 1),
p as (select a.feature as f, b.feature as g, count(*) as n_both from feat a join feat b on a.item = b.item and a.feature <> b.feature group by 1, 2)
select f, g, n_both, round(n_both / (x.c + y.c - n_both), 6) as jaccard, round(n_both * n / (x.c * y.c), 6) as lift, row_number() over (partition by f order by n_both desc, g) as rank, row_number() over (partition by f order by n_both desc, g) <= 10 as is_top10
from p join s x on x.feature = f join s y on y.feature = g, n"""))
def _(c):
    from ..operators.cooccurrence import feature_pairs

    pairs = feature_pairs(c.feat).select("f", "g", "n_both", F.round("jaccard", 6).alias("jaccard"), F.round("lift", 6).alias("lift"))
    ranked = ranking.row_rank(pairs, ["f"], [F.desc("n_both"), "g"])
    return ranked.withColumn("is_top10", F.col("rank") <= 10)


@query("jon10_bipartite", twin("feat tok", "select token, feature, count(*) as n_both from tok join feat using (item) group by 1, 2"))
def _(c):
    return c.tok.join(c.feat, "item").groupBy("token", "feature").agg(F.count("*").alias("n_both"))


_FORMS = ("the", "tion", "ing", "idiot", "queue", "ciones")


@query("jon11_containment", f"select doc_id, form from documents, (values {', '.join(f'({f!r})' for f in _FORMS)}) v(form) where contains(text, form)")
def _(c):
    # A theta join against a lexicon of fixed size: one pass over the texts, no product with them.
    held = F.array_compact(F.array(*[F.when(F.col("text").contains(f), F.lit(f)) for f in _FORMS]))
    return c.table("documents").select("doc_id", F.explode(held).alias("form"))


@query("jon12_blocked_bands", """with l as (select p_partkey as left_id, p_brand, p_retailprice as price from part where p_size <= 25), r as (select p_partkey as right_id, p_brand, p_retailprice as other from part where p_size > 25),
x as (select left_id, right_id, round(100 - abs(price - other), 4) as score from l join r using (p_brand) where abs(price - other) <= 5)
select left_id, right_id, score, rank from (select *, row_number() over (partition by left_id order by score desc, right_id) as rank from x) where rank <= 3""")
def _(c):
    """Both sides together are the whole table. Candidates depend on brand and price alone, so equal prices meet once: of
    the right side's the three smallest ids, and the left side's rows come back at the end."""
    part, price = c.table("part"), F.col("p_retailprice").alias("price")
    left = part.filter("p_size <= 25").select(F.col("p_partkey").alias("left_id"), "p_brand", price)
    right = part.filter("p_size > 25").select(F.col("p_partkey").alias("right_id"), "p_brand", price)
    right = ranking.top_n(right, ["p_brand", "price"], ["right_id"], 3).select("right_id", "p_brand", F.col("price").alias("other"), F.floor(F.col("price") / 5).alias("band"))
    asked = left.select("p_brand", "price").distinct().withColumn("band", F.explode(F.sequence(F.floor(F.col("price") / 5) - 1, F.floor(F.col("price") / 5) + 1)))
    met = asked.join(right, ["p_brand", "band"]).filter(F.abs(F.col("price") - F.col("other")) <= 5)
    met = met.select("p_brand", "price", "right_id", F.round(100 - F.abs(F.col("price") - F.col("other")), 4).alias("score"))
    best = ranking.top_n(met, ["p_brand", "price"], [F.desc("score"), "right_id"], 3)
    return left.join(best, ["p_brand", "price"]).select("left_id", "right_id", "score", "rank")


@query("jon13_fallback_resolution", """select n_nationkey, coalesce(a.v, b.v, 'none') as resolved, case when a.v is not null then 'alias' when b.v is not null then 'region' else 'unresolved' end as basis
from nation left join (values ('NATION_3', 'three'), ('NATION_7', 'seven')) a(k, v) on a.k = n_name left join (select r_regionkey, lower(r_name) as v from region where r_name like 'A%') b on b.r_regionkey = n_regionkey""")
def _(c):
    alias = c.frame([("NATION_3", "three"), ("NATION_7", "seven")], "n_name string, a string")
    region = c.table("region").filter("r_name like 'A%'").select(F.col("r_regionkey").alias("n_regionkey"), F.lower("r_name").alias("b"))
    return c.table("nation").join(F.broadcast(alias), "n_name", "left").join(F.broadcast(region), "n_regionkey", "left").select(
        "n_nationkey", F.coalesce("a", "b", F.lit("none")).alias("resolved"), F.when(F.col("a").isNotNull(), "alias").when(F.col("b").isNotNull(), "region").otherwise("unresolved").alias("basis"))


@query("jon14_parameter_grid", twin("votes", "select pool, gamma, count(*) as n, round(sum((1 - gamma) * q1 + gamma * q2), 4) as total from votes, (values (100), (150)) p(pool), (values (0.25), (0.5), (0.75)) g(gamma) where q1 >= pool group by 1, 2").replace("(0.25), (0.5), (0.75)", "(0.25::double), (0.5::double), (0.75::double)"))
def _(c):
    grid = c.frame([(p, g) for p in (100, 150) for g in (0.25, 0.5, 0.75)], "pool int, gamma double")
    return c.votes.join(F.broadcast(grid), F.col("q1") >= F.col("pool")).groupBy("pool", "gamma").agg(F.count("*").alias("n"), F.round(F.sum((1 - F.col("gamma")) * F.col("q1") + F.col("gamma") * F.col("q2")), 4).alias("total"))


@query("jon15_all_pairs", "select a.n_nationkey as a, b.n_nationkey as b, a.n_regionkey = b.n_regionkey as same from nation a, nation b where a.n_nationkey < b.n_nationkey")
def _(c):
    n = c.table("nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("rb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", (F.col("ra") == F.col("rb")).alias("same"))


@query("jon16_fanout_safe", """with e as (select user_id, count(*) filter (where event_type = 'click') as clicks, count(*) as n from events group by 1)
select c_mktsegment as segment, count(*) as users, coalesce(sum(clicks), 0)::bigint as clicks, coalesce(sum(n), 0)::bigint as seen from customer left join e on user_id = c_custkey group by 1""")
def _(c):
    per_user = c.table("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count("*").alias("n"))
    return c.table("customer").join(per_user, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("users"), F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"), F.coalesce(F.sum("n"), F.lit(0)).alias("seen"))


@query("jon17_click_through", twin("feat", """, u as (select user_id, cast(json_extract_string(props, '$.k') as bigint) as item from events where event_type = 'error'),
k as (select user_id, cast(json_extract_string(props, '$.k') as bigint) as item from events where event_type = 'click')
select feature, count(*) as n, count(distinct k.user_id) as users from (select distinct user_id from u) u join k using (user_id) join feat on feat.item = k.item group by 1 having count(*) >= 5"""))
def _(c):
    e = c.table("events").select("user_id", "event_type", F.from_json("props", "k long")["k"].alias("item"))
    missed = e.filter("event_type = 'error'").select("user_id")
    clicks = e.filter("event_type = 'click'").select("user_id", "item").join(missed, "user_id", "left_semi")
    return clicks.join(c.feat, "item").groupBy("feature").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).filter("n >= 5")


@query("jon18_overlap_classes", twin("rk", """, a as (select item, rank from rk where source = 'A'), b as (select item, rank from rk where source = 'N' and rank <= 60)
select a.item, case when b.item is null then 'NO_MATCH' when abs(a.rank - b.rank) <= 10 then 'MATCH' else 'MATCH_REVIEW' end as status from a left join b using (item)"""))
def _(c):
    a, b = c.rk.filter("source = 'A'").select("item", "rank"), c.rk.filter("source = 'N' and rank <= 60").select("item", F.col("rank").alias("other"))
    near = F.abs(F.col("rank") - F.col("other")) <= 10
    return a.join(b, "item", "left").select("item", F.when(F.col("other").isNull(), "NO_MATCH").when(near, "MATCH").otherwise("MATCH_REVIEW").alias("status"))
