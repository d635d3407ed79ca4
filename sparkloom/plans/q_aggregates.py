"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cooccurrence, ranking, similarity
from .catalogue import twin
from .q_joins import _LIFT, lift
from .registry import query


@query("agg01_group_by", "select l_returnflag, l_linestatus, sum(l_quantity) as qty, round(avg(l_discount), 6) as mean_discount, min(l_tax) as low, max(l_tax) as high, count(*) as n, bool_or(l_quantity >= 50) as any_large from lineitem group by 1, 2")
def _(c):
    return c.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high"), F.count("*").alias("n"), F.bool_or(F.col("l_quantity") >= 50).alias("any_large"))


@query("agg02_token_idf", twin("tok", ", n as (select count(distinct item) as n from tok) select token, count(*) as df, round(ln((n + 1) / (count(*) + 1)) + 1, 6) as idf from tok, n group by token, n"))
def _(c):
    return similarity.idf(c.tok).select("token", "df", F.round("idf", 6).alias("idf"))


@query("agg03_feature_dictionary", twin("feat", ", n as (select count(distinct item) as n from feat) select feature, count(*) as items, round(count(*) / n, 6) as share, round(avg(strength), 6) as mean, round(median(strength), 6) as median, round(stddev_pop(strength), 6) as sd from feat, n group by feature, n"))
def _(c):
    n = F.broadcast(c.feat.agg(F.count_distinct("item").alias("n")))
    return c.feat.crossJoin(n).groupBy("feature").agg(
        F.count("*").alias("items"), F.round(F.count("*") / F.max("n"), 6).alias("share"), F.round(F.avg("strength"), 6).alias("mean"), F.round(F.median("strength"), 6).alias("median"), F.round(F.stddev_pop("strength"), 6).alias("sd"))


@query("agg04_distribution", "select o_orderpriority, count(*) as n, round(avg(o_totalprice), 2) as mean, round(quantile_cont(o_totalprice, 0.25), 2) as q25, round(quantile_cont(o_totalprice, 0.5), 2) as q50, round(quantile_cont(o_totalprice, 0.75), 2) as q75, min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1")
def _(c):
    q = [F.round(F.percentile("o_totalprice", p / 100), 2).alias(f"q{p}") for p in (25, 50, 75)]
    return c.table("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"), *q, F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("agg05_crosstab", "select coalesce(c_mktsegment, 'ALL') as segment, coalesce(cast(c_nationkey as varchar), 'ALL') as nation, count(*) as n from customer group by cube(c_mktsegment, c_nationkey)")
def _(c):
    return c.table("customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).select(F.coalesce("c_mktsegment", F.lit("ALL")).alias("segment"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("ALL")).alias("nation"), "n")


@query("agg06_pivot", "select l_returnflag, round(sum(l_tax) filter (where l_linestatus = 'F'), 2) as \"F\", round(sum(l_tax) filter (where l_linestatus = 'O'), 2) as \"O\" from lineitem group by 1")
def _(c):
    return c.table("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_tax"), 2))


@query("agg07_grouping_levels", "select c_mktsegment as segment, o_orderpriority as priority, count(*) as n, round(avg(o_totalprice), 2) as mean from orders join customer on o_custkey = c_custkey group by grouping sets ((), (c_mktsegment), (o_orderpriority))")
def _(c):
    c.table("orders").join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey")).createOrReplaceTempView("sparkloom_agg07")
    return c.spark.sql("select c_mktsegment as segment, o_orderpriority as priority, count(*) as n, round(avg(o_totalprice), 2) as mean from sparkloom_agg07 group by grouping sets ((), (c_mktsegment), (o_orderpriority))")


@query("agg08_first_per_group", """select p_name, min(p_partkey) as first_id, arg_min(p_brand, p_partkey) as first_brand, min(p_size) as best, array_to_string(list_sort(list(distinct p_type)), '|') as types, 'N_' || substr(sha1(p_name), 1, 12) as key from part group by 1""" .replace("sha1(p_name)", "md5(p_name)"))
def _(c):
    return c.table("part").groupBy("p_name").agg(
        F.min("p_partkey").alias("first_id"), F.min_by("p_brand", "p_partkey").alias("first_brand"), F.min("p_size").alias("best"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types")).withColumn("key", F.concat(F.lit("N_"), F.substring(F.md5("p_name"), 1, 12)))


@query("agg09_conditional_count", "select user_id, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where event_type = 'purchase' and value > 10) as buys from events group by 1")
def _(c):
    return c.table("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 10)).alias("buys"))


@query("agg10_most_common", "select p_name, count(*) as n from part group by 1 order by n desc, p_name limit 10")
def _(c):
    return c.table("part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(10)


@query("agg11_distinct_sets", twin("tok feat", "select 'notes' as kind, count(*) as items, count(distinct s) as sets from (select item, list_sort(list(token)) as s from tok group by 1) union all select 'features', count(*), count(distinct s) from (select item, list_sort(list(feature)) as s from feat group by 1)"))
def _(c):
    def sets(df, col, kind):
        return df.groupBy("item").agg(F.array_sort(F.collect_set(col)).alias("s")).agg(F.count("*").alias("items"), F.count_distinct("s").alias("sets")).select(F.lit(kind).alias("kind"), "items", "sets")

    return sets(c.tok, "token", "notes").unionByName(sets(c.feat, "feature", "features"))


@query("agg12_brand_mode", twin("feat pop", """, x as (select brand, split_part(feature, ' ', 2) as family, strength, item, row_number() over (partition by brand order by strength desc, item, feature) as place from feat join pop using (item)),
g as (select brand, family, count(*) as n, min(place) as best from x group by 1, 2) select brand, family, n from (select *, row_number() over (partition by brand order by n desc, best) as r from g) where r = 1"""))
def _(c):
    rows = ranking.row_rank(c.feat.join(c.pop, "item"), ["brand"], [F.desc("strength"), "item", "feature"], "place")
    g = rows.groupBy("brand", F.split_part("feature", F.lit(" "), F.lit(2)).alias("family")).agg(F.count("*").alias("n"), F.min("place").alias("best"))
    return ranking.first_by(g, ["brand"], [F.desc("n"), "best"]).select("brand", "family", "n")


@query("agg13_token_feature_lift", twin("feat tok", _LIFT + " select * from l"))
def _(c):
    return lift(c)


_SUB = """, sub as (select distinct token as subset, item from tok where token like 'red%' or token like 'small%'), n as (select count(distinct item)::double as n from feat), base as (select feature, count(*) / n as p0 from feat, n group by feature, n),
m as (select subset, count(*)::double as m from sub group by 1), b as (select subset, feature, count(*) as k from sub join feat using (item) group by 1, 2)"""


@query("agg14_subset_lift_ci", twin("feat tok", _SUB + " select subset, feature, k, round(k / m / p0, 6) as lift, round(greatest(k / m - 1.96 * sqrt(k / m * (1 - k / m) / m), 0) / p0, 6) as low from b join m using (subset) join base using (feature) where m >= 10 and k >= 3"))
def _(c):
    sub = c.tok.filter(F.col("token").startswith("red") | F.col("token").startswith("small")).select(F.col("token").alias("subset"), "item").distinct()
    from ..functions.stats import subset_lift

    return subset_lift(c.feat, sub, least_items=10, least_support=3).select("subset", "feature", "k", F.round("lift", 6).alias("lift"), F.round("low", 6).alias("low"))


@query("agg15_control_lift", twin("feat", """, items as (select distinct item from feat), sub as (select 'control' as subset, item from (select item, row_number() over (order by md5(cast(item as varchar)), item) as r from items) where r <= 40), n as (select count(distinct item)::double as n from feat), base as (select feature, count(*) / n as p0 from feat, n group by feature, n), m as (select subset, count(*)::double as m from sub group by 1), b as (select subset, feature, count(*) as k from sub join feat using (item) group by 1, 2)
select feature, k, round(k / m / p0, 6) as lift from b join m using (subset) join base using (feature)"""))
def _(c):
    from ..functions.stats import subset_lift
    from ..operators.sampling import hashed_sample

    sub = hashed_sample(c.feat.select("item").distinct(), "item", 40).select(F.lit("control").alias("subset"), "item")
    return subset_lift(c.feat, sub, 0, 0).select("feature", "k", F.round("lift", 6).alias("lift"))


_SHARES = ", sh as (select feature, avg(q1 / (q1 + q2 + q3 + q4)) as s1, avg(q2 / (q1 + q2 + q3 + q4)) as s2, avg(q3 / (q1 + q2 + q3 + q4)) as s3, avg(q4 / (q1 + q2 + q3 + q4)) as s4 from feat join votes using (item) group by 1), m as (select avg(q1 / (q1 + q2 + q3 + q4)) as m1, avg(q2 / (q1 + q2 + q3 + q4)) as m2, avg(q3 / (q1 + q2 + q3 + q4)) as m3, avg(q4 / (q1 + q2 + q3 + q4)) as m4 from votes)"


@query("agg16_season_lift", twin("feat votes", _SHARES + """, l as (select feature, unnest(['q1', 'q2', 'q3', 'q4']) as season, unnest([round(s1 / m1, 6), round(s2 / m2, 6), round(s3 / m3, 6), round(s4 / m4, 6)]) as lift from sh, m),
r as (select *, row_number() over (partition by feature order by lift desc, season) as r from l) select feature, max(season) filter (where r = 1) as strongest, max(season) filter (where r = 2) as second, max(season) filter (where r = 4) as weakest, max(lift) as top_lift from r group by 1"""))
def _(c):
    quarters = ["q1", "q2", "q3", "q4"]
    shares = c.votes.select("item", similarity.share(quarters).alias("s"))
    base = F.broadcast(shares.agg(F.array(*[F.avg(F.col("s")[i]) for i in range(4)]).alias("m")))
    per = c.feat.join(shares, "item").groupBy("feature").agg(F.array(*[F.avg(F.col("s")[i]) for i in range(4)]).alias("s")).crossJoin(base)
    seasons = F.array(*[F.struct((-F.round(F.col("s")[i] / F.col("m")[i], 6)).alias("neg"), F.lit(q).alias("season")) for i, q in enumerate(quarters)])
    ordered = per.withColumn("o", F.array_sort(seasons))
    return ordered.select("feature", F.col("o")[0]["season"].alias("strongest"), F.col("o")[1]["season"].alias("second"), F.col("o")[3]["season"].alias("weakest"), (-F.col("o")[0]["neg"]).alias("top_lift"))


@query("agg17_tendency", twin("feat votes", """, t as (select feature, round(avg(day / (day + night)), 8) as d from feat join votes using (item) group by 1), e as (select quantile_cont(d, 0.25) as lo, quantile_cont(d, 0.75) as hi from t)
select feature, case when d is null then 'INSUFFICIENT' when d <= lo then 'Night' when d >= hi then 'Day' else 'Neutral' end as tendency from t, e"""))
def _(c):
    t = c.feat.join(c.votes, "item").groupBy("feature").agg(F.round(F.avg(F.col("day") / (F.col("day") + F.col("night"))), 8).alias("d"))
    edges = F.broadcast(t.agg(F.percentile("d", 0.25).alias("lo"), F.percentile("d", 0.75).alias("hi")))
    return t.crossJoin(edges).select("feature", F.when(F.col("d").isNull(), "INSUFFICIENT").when(F.col("d") <= F.col("lo"), "Night").when(F.col("d") >= F.col("hi"), "Day").otherwise("Neutral").alias("tendency"))


@query("agg18_share_vectors", twin("votes", "select item, case when day + night >= 580 then round(day / (day + night), 6) end as day_share, case when day + night >= 580 then round(night / (day + night), 6) end as night_share from votes"))
def _(c):
    return c.votes.withColumn("s", similarity.share(["day", "night"], 580)).select("item", F.round(F.col("s")[0], 6).alias("day_share"), F.round(F.col("s")[1], 6).alias("night_share"))


@query("agg19_coverage", twin("votes", "select round(avg(case when day + night >= 580 then 1.0 else 0.0 end), 6) as reliable, round(avg(case when q1 >= 150 then 1.0 else 0.0 end), 6) as spring from votes"))
def _(c):
    of = lambda cond: F.round(F.avg(F.expr(cond).cast("double")), 6)
    return c.votes.agg(of("day + night >= 580").alias("reliable"), of("q1 >= 150").alias("spring"))


_FAMILY = ", fs as (select item, split_part(feature, ' ', 2) as family, round(sum(strength), 4) as s from feat where feature not like '%PROMO' group by 1, 2), sc as (select item, family, round(s / sum(s) over (partition by item), 6) as score from fs)"


def family_score(c):
    """Strength by family, as a share of the item's mapped strength; PROMO features are a modifier and map to none."""
    mapped = c.feat.filter(~F.col("feature").endswith("PROMO"))
    s = mapped.groupBy("item", F.split_part("feature", F.lit(" "), F.lit(2)).alias("family")).agg(F.round(F.sum("strength"), 4).alias("s"))
    return s.select("item", "family", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("item")), 6).alias("score"))


@query("agg20_family_score", twin("feat", _FAMILY + ", r as (select *, row_number() over (partition by item order by score desc, family) as r from sc) select item, max(family) filter (where r = 1) as family, max(score) filter (where r = 1) as top1, coalesce(max(score) filter (where r = 2), 0) as top2, round(max(score) filter (where r = 1) - coalesce(max(score) filter (where r = 2), 0), 6) as margin from r group by 1"))
def _(c):
    ordered = family_score(c).groupBy("item").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "family"))).alias("o"))
    top = lambda i: F.coalesce(-F.try_element_at("o", F.lit(i))["neg"], F.lit(0.0))
    return ordered.select("item", F.col("o")[0]["family"].alias("family"), top(1).alias("top1"), top(2).alias("top2"), F.round(top(1) - top(2), 6).alias("margin"))


@query("agg21_cluster_label", twin("feat pop", """, n as (select count(distinct item)::double as n from feat), base as (select feature, count(*) / n as p0 from feat, n group by feature, n), m as (select grp, count(*)::double as m from pop group by 1), b as (select grp, feature, count(*) as k from pop join feat using (item) group by 1, 2),
l as (select grp, feature, round(k / m, 6) as coverage, round(k / m / p0, 6) as lift from b join m using (grp) join base using (feature) where k / m >= 0.2) select grp, feature as label, coverage, lift from (select *, row_number() over (partition by grp order by lift desc, feature) as r from l) where r = 1"""))
def _(c):
    from ..functions.stats import subset_lift

    l = subset_lift(c.feat, c.pop.select(F.col("grp").alias("subset"), "item"), 0, 0).select(F.col("subset").alias("grp"), F.col("feature").alias("label"), F.round("p", 6).alias("coverage"), F.round("lift", 6).alias("lift"))  # noqa: E741
    return ranking.first_by(l.filter("coverage >= 0.2"), ["grp"], [F.desc("lift"), "label"])


@query("agg22_duplicate_groups", """with g as (select p_brand, p_name, p_type, count(*) as n from part group by all having count(*) >= 2) select p_brand, p_name, p_type, n, p_brand || '_group_' || lpad(cast(row_number() over (partition by p_brand order by p_name, p_type) as varchar), 3, '0') as group_id from g""")
def _(c):
    g = c.table("part").groupBy("p_brand", "p_name", "p_type").agg(F.count("*").alias("n")).filter("n >= 2")
    serial = F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_name", "p_type"))
    return g.withColumn("group_id", F.concat("p_brand", F.lit("_group_"), F.lpad(serial.cast("string"), 3, "0")))


_BEFORE = "select user_id, max(case when event_type = 'view' then 1 else 0 end) as was, max(case when event_type = 'purchase' then 1 else 0 end) as now from events where value < 3 group by 1"


@query("agg23_transitions", f"select case when was = now then 'same' when was < now then 'gained' else 'lost' end as change, count(*) as n from ({_BEFORE}) group by 1")
def _(c):
    one = lambda kind: F.max(F.when(F.col("event_type") == kind, 1).otherwise(0))
    u = c.table("events").filter("value < 3").groupBy("user_id").agg(one("view").alias("was"), one("purchase").alias("now"))
    return u.groupBy(F.when(F.col("was") == F.col("now"), "same").when(F.col("was") < F.col("now"), "gained").otherwise("lost").alias("change")).agg(F.count("*").alias("n"))


@query("agg24_selection_overlap", twin("rk", ", a as (select item from rk where source = 'A' and rank <= 30), b as (select item from rk where source = 'R' and rank <= 30) select count(*) filter (where a.item is not null and b.item is not null) as n_both, round(count(*) filter (where a.item is not null and b.item is not null) / count(*), 6) as jaccard from a full join b using (item)"))
def _(c):
    pick = lambda s, name: c.rk.filter((F.col("source") == s) & (F.col("rank") <= 30)).select("item", F.lit(1).alias(name))
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return pick("A", "a").join(pick("R", "b"), "item", "full").agg(both.alias("n_both"), F.round(both / F.count("*"), 6).alias("jaccard"))


@query("agg25_concentration", "with g as (select p_brand, count(*) as n from part group by 1), r as (select n, row_number() over (order by n desc, p_brand) as r from g) select round(sum(n) filter (where r <= 10) / sum(n), 6) as top10_share, round(max(n) / sum(n), 6) as top_share, round(stddev_pop(n) / avg(n), 6) as cv from r")
def _(c):
    g = c.table("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    top = g.orderBy(F.desc("n"), "p_brand").limit(10).agg(F.sum("n").alias("top"))
    return g.agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.stddev_pop("n").alias("sd"), F.avg("n").alias("mean")).crossJoin(F.broadcast(top)).select(
        F.round(F.col("top") / F.col("all"), 6).alias("top10_share"), F.round(F.col("most") / F.col("all"), 6).alias("top_share"), F.round(F.col("sd") / F.col("mean"), 6).alias("cv"))


@query("agg26_union_coverage", twin("feat pop rk", "select source, count(distinct feature) as features, count(distinct brand) as brands from rk join feat using (item) join pop using (item) where rank <= 10 group by 1"))
def _(c):
    chosen = c.rk.filter("rank <= 10")
    return chosen.join(c.feat, "item").join(c.pop, "item").groupBy("source").agg(F.count_distinct("feature").alias("features"), F.count_distinct("brand").alias("brands"))


@query("agg27_unnest", "select t as token, count(*) as n from (select unnest(string_split(p_name, ' ')) as t from part) group by 1")
def _(c):
    return c.table("part").select(F.explode(F.split("p_name", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
