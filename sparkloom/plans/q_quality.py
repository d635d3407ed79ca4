"""Constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from .catalogue import twin
from .registry import query


@query("dq01_unique_keys", "select 'orders' as \"check\", count(*) = count(distinct o_orderkey) as ok, count(*) - count(distinct o_orderkey) as detail from orders union all select 'part names', false, (select count(*) from (select 1 from part group by p_name having count(*) > 1))")
def _(c):
    return checks.suite(checks.unique(c.table("orders"), ["o_orderkey"], "orders"), checks.unique(c.table("part"), ["p_name"], "part names"))


@query("dq02_master_reconciliation", "with a as (select p_brand, count(*) as n from part group by 1), b as (select p_brand, count(*) filter (where p_size > 2) as m from part group by 1) select p_brand, n, m from a join b using (p_brand) where n <> m")
def _(c):
    p = c.table("part")
    a, b = p.groupBy("p_brand").agg(F.count("*").alias("n")), p.groupBy("p_brand").agg(F.count_if(F.col("p_size") > 2).alias("m"))
    return a.join(b, "p_brand", "full").filter("not n <=> m")


@query("dq03_check_suite", twin("edge", """select 'regions' as "check", count(*) = 5 as ok, count(*) as detail from region
union all select 'nation to region', count(*) = 0, count(*) from nation where n_regionkey not in (select r_regionkey from region)
union all select 'line to part', count(*) = 0, count(*) from lineitem where l_partkey not in (select p_partkey from part)
union all select 'flags', count(*) = 0, count(*) from lineitem where l_returnflag not in ('A', 'N')
union all select 'no self edge', count(*) = 0, count(*) from edge where src = dst
union all select 'sizes', count(*) = 0, count(*) from part where not p_size between 1 and 50
union all select 'round trip', true, 0"""))
def _(c):
    t = c.table
    again = t("nation").select(F.from_json(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")), t("nation").schema).alias("r")).select("r.*")
    return checks.suite(
        checks.count_is(t("region"), 5, "regions"), checks.references(t("nation"), "n_regionkey", t("region"), "r_regionkey", "nation to region"),
        checks.references(t("lineitem"), "l_partkey", t("part"), "p_partkey", "line to part"), checks.holds(t("lineitem"), "l_returnflag in ('A', 'N')", "flags"),
        checks.holds(c.edge, "src <> dst", "no self edge"), checks.holds(t("part"), "p_size between 1 and 50", "sizes"), checks.same_rows(t("nation"), again, "round trip"))


@query("dq04_fits_decimal", "select count(*) filter (where abs(round(l_discount, 2) - l_discount) < 0.00001) as discount_ok, count(*) filter (where l_extendedprice < 100000 - 0.005) as price_ok from lineitem")
def _(c):
    return c.table("lineitem").agg(F.count_if(checks.fits_decimal("l_discount", 4, 2)).alias("discount_ok"), F.count_if(checks.fits_decimal("l_extendedprice", 7, 2)).alias("price_ok"))


@query("dq05_known_answers", "select 'mean size' as \"check\", abs(avg(p_size) - 25.5) <= 2 as ok, case when abs(avg(p_size) - 25.5) <= 2 then 0 else 1 end::bigint as detail from part")
def _(c):
    return checks.within(c.table("part").agg(F.avg("p_size").alias("m")), "m", 25.5, 2.0, "mean size")


@query("dq06_immutability", "select 'same rows' as \"check\", true as ok, 0::bigint as detail")
def _(c):
    p = c.table("part")
    return checks.same_rows(p, p.withColumn("flag", F.col("p_size") > 10).select(p.columns), "same rows")


@query("dq07_constraints", "select 'pk' as \"check\", true as ok, 0::bigint as detail union all select 'fk', count(*) = 0, count(*) from supplier where s_nationkey not in (select n_nationkey from nation) union all select 'balance', count(*) = 0, count(*) from supplier where not (s_acctbal >= 0)")
def _(c):
    s = c.table("supplier")
    return checks.suite(checks.unique(s, ["s_suppkey"], "pk"), checks.references(s, "s_nationkey", c.table("nation"), "n_nationkey", "fk"), checks.holds(s, "s_acctbal >= 0", "balance"))


@query("dq08_missing_audit", twin("votes", "select 'q1' as field, count(*) filter (where q1 = 0) as zero, 0::bigint as missing, count(*) filter (where q1 <> 0) as other from votes union all select 'night', count(*) filter (where night = 0), 0, count(*) filter (where night <> 0) from votes"))
def _(c):
    long = c.votes.unpivot([], ["q1", "night"], "field", "v")
    return long.groupBy("field").agg(F.count_if(F.col("v") == 0).alias("zero"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("v") != 0).alias("other"))


@query("dq09_xor_classes", twin("feat tok pop", ", f as (select distinct item from feat), t as (select distinct item from tok where token like 'red%') select case when f.item is not null and t.item is not null then 'both' when f.item is not null then 'features' when t.item is not null then 'notes' else 'none' end as kind, count(*) as n from pop left join f on f.item = pop.item left join t on t.item = pop.item group by 1"))
def _(c):
    f, t = c.feat.select("item", F.lit(True).alias("f")).distinct(), c.tok.filter(F.col("token").startswith("red")).select("item", F.lit(True).alias("t")).distinct()
    kind = F.when(F.col("f") & F.col("t"), "both").when(F.col("f"), "features").when(F.col("t"), "notes").otherwise("none")
    return c.pop.join(f, "item", "left").join(t, "item", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
