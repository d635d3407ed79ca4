"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import twin
from .registry import query

_REQUESTS = [(1, ["Brand#1 ECONOMY", "Brand#2 SMALL"], ["Brand#3 PROMO"]), (2, ["Brand#4 LARGE"], ["Brand#5 MEDIUM"]), (3, ["Brand#6 STANDARD", "Brand#7 STANDARD", "Brand#8 SMALL"], []), (4, ["Brand#9 PROMO", "Brand#10 PROMO"], ["Brand#11 LARGE", "Brand#12 ECONOMY"])]
REQUESTS_SQL = ", req(q, core, avoid) as (values " + ", ".join(f"({q}, {c or '[]::varchar[]'}, {a or '[]::varchar[]'})" for q, c, a in _REQUESTS) + ")"


def requests(c):
    """A few literal requests: wanted and unwanted features."""
    return c.frame(_REQUESTS, "q int, core array<string>, avoid array<string>")


_HAS = ", has as (select item, list_sort(list(feature)) as f from feat group by item)"


def has(c):
    return c.feat.groupBy("item").agg(F.array_sort(F.collect_list("feature")).alias("f"))


@query("flt01_usable_pool", twin("feat tok pop", "select item, people from pop where people >= 100 and item in (select item from feat) and item in (select item from tok)"))
def _(c):
    return c.pop.filter("people >= 100").join(c.feat, "item", "left_semi").join(c.tok, "item", "left_semi").select("item", "people")


@query("flt02_confident_edge", twin("edge", "select * from edge where up >= 3 and up > down"))
def _(c):
    return c.edge.filter("up >= 3 and up > down")


_CRITERIA = {"A": "up >= 3 and up > down", "B": "up >= 5 and up >= 0.7 * (up + down)", "C": "up >= 10 and up >= 0.7 * (up + down)", "D": "up + down >= 20 and up >= 0.8 * (up + down)"}
_MARKED = "select u, v, up, down, a.brand = b.brand as same from pair join pop a on a.item = u join pop b on b.item = v"


@query("flt03_edge_criteria", twin("edge pair pop", f", m as ({_MARKED}), x as (" + " union all ".join(f"select '{k}' as criterion, * from m where {e}" for k, e in _CRITERIA.items()) + """)
select criterion, flag, count(*) as edges, round(avg(case when same then 1.0 else 0.0 end), 6) as same_share, median(up + down) as median_votes
from x, (values ('all'), ('other brands')) f(flag) where flag = 'all' or not same group by 1, 2"""))
def _(c):
    a, b = c.pop.select(F.col("item").alias("u"), F.col("brand").alias("a")), c.pop.select(F.col("item").alias("v"), F.col("brand").alias("b"))
    marked = c.pair.join(a, "u").join(b, "v").withColumn("same", F.col("a") == F.col("b"))
    held = F.array_compact(F.array(*[F.when(F.expr(e), F.lit(k)) for k, e in _CRITERIA.items()]))
    flags = F.when(F.col("same"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("other brands")))
    spread = marked.withColumn("criterion", F.explode(held)).withColumn("flag", F.explode(flags))
    return spread.groupBy("criterion", "flag").agg(F.count("*").alias("edges"), F.round(F.avg(F.col("same").cast("double")), 6).alias("same_share"), F.median(F.col("up") + F.col("down")).alias("median_votes"))


@query("flt04_edges_within", twin("edge pop", ", s as (select item from pop where people >= 330) select src, dst from edge where src in (select item from s) and dst in (select item from s)"))
def _(c):
    inside = c.pop.filter("people >= 330")
    return c.edge.join(inside.select(F.col("item").alias("src")), "src", "left_semi").join(inside.select(F.col("item").alias("dst")), "dst", "left_semi").select("src", "dst")


@query("flt05_valid_relation", twin("edge", "select 'positive ids' as rule, count(*) as n from edge where src > 0 and dst > 0 and up is not null and down is not null union all select 'ids from 0', count(*) from edge where src >= 0 and dst >= 0 and up is not null and down is not null"))
def _(c):
    voted = c.edge.filter("up is not null and down is not null")
    return voted.agg(F.count_if((F.col("src") > 0) & (F.col("dst") > 0)).alias("positive ids"), F.count_if((F.col("src") >= 0) & (F.col("dst") >= 0)).alias("ids from 0")).unpivot([], ["positive ids", "ids from 0"], "rule", "n")


@query("flt06_pair_labels", twin("edge pair", "select u, v, case when up >= 0.8 * (up + down) then 1 else 0 end as label from pair where up + down >= 10 and (up >= 0.8 * (up + down) or up <= 0.4 * (up + down))"))
def _(c):
    total = F.col("up") + F.col("down")
    good, bad = F.col("up") >= 0.8 * total, F.col("up") <= 0.4 * total
    return c.pair.filter((total >= 10) & (good | bad)).select("u", "v", F.when(good, 1).otherwise(0).alias("label"))


@query("flt07_threshold_ladder", twin("pop", "select t as threshold, count(*) filter (where people >= t) as n, round(count(*) filter (where people >= t) / count(*), 6) as share from pop, (values (1), (5), (10), (20), (50), (330), (340)) v(t) group by t"))
def _(c):
    steps = c.pop.select("people", F.explode(F.array(*map(F.lit, (1, 5, 10, 20, 50, 330, 340)))).alias("threshold"))
    reached = F.count_if(F.col("people") >= F.col("threshold"))
    return steps.groupBy("threshold").agg(reached.alias("n"), F.round(reached / F.count("*"), 6).alias("share"))


@query("flt08_hard_and", twin("feat", REQUESTS_SQL + _HAS + " select q, item from req, has where list_has_all(f, core)"))
def _(c):
    # Relational division: an item must match as many of the request's features as there are.
    wanted = requests(c).select("q", F.explode("core").alias("feature"), F.size("core").alias("n"))
    return c.feat.join(F.broadcast(wanted), "feature").groupBy("q", "item", "n").agg(F.count_distinct("feature").alias("met")).filter("met = n").select("q", "item")


@query("flt09_or", twin("feat", REQUESTS_SQL + _HAS + " select q, item from req, has where list_has_any(f, core)"))
def _(c):
    return c.feat.join(F.broadcast(requests(c).select("q", F.explode("core").alias("feature"))), "feature").select("q", "item").distinct()


@query("flt10_avoid_anti", twin("feat pop", REQUESTS_SQL + _HAS + " select q, pop.item from req, pop left join has on has.item = pop.item where not coalesce(list_has_any(f, avoid), false)"))
def _(c):
    unwanted = c.feat.join(F.broadcast(requests(c).select("q", F.explode("avoid").alias("feature"))), "feature").select("q", "item")
    return c.pop.select("item").crossJoin(F.broadcast(requests(c).select("q"))).join(unwanted, ["q", "item"], "left_anti").select("q", "item")


@query("flt11_population", twin("pop", "select item, people from pop where people >= 330"))
def _(c):
    return c.pop.filter("people >= 330").select("item", "people")


@query("flt12_soft_filter", twin("feat", REQUESTS_SQL + " select q, item, round(sum(strength), 4) as score from feat, req where list_contains(core, feature) group by 1, 2 having sum(strength) > 0"))
def _(c):
    wanted = F.broadcast(requests(c).select("q", F.explode("core").alias("feature")))
    return c.feat.join(wanted, "feature").groupBy("q", "item").agg(F.round(F.sum("strength"), 4).alias("score")).filter("score > 0")


@query("flt13_form_compatible", """with p as (select p_partkey, p_type, p_size, case when p_type in ('ECONOMY', 'STANDARD') then 'plain' when p_type = 'PROMO' then 'set' end as form, case when p_size >= 40 then ['L', 'XL'] when p_size >= 20 then ['M', 'L'] else []::varchar[] end as labels from part),
k(form, labels) as (values ('plain', ['L']), ('set', ['M']), (null, []::varchar[]))
select p_partkey, coalesce(k.form, 'any') as wanted, (p.form is null or k.form is null or p.form = k.form or (p.form = 'set' and k.form = 'plain')) and (len(p.labels) = 0 or len(k.labels) = 0 or list_has_any(p.labels, k.labels)) as fits from p, k""")
def _(c):
    p = c.table("part").select(
        "p_partkey", F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "plain").when(F.col("p_type") == "PROMO", "set").alias("form"),
        F.when(F.col("p_size") >= 40, F.array(F.lit("L"), F.lit("XL"))).when(F.col("p_size") >= 20, F.array(F.lit("M"), F.lit("L"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    k = c.frame([("plain", ["L"]), ("set", ["M"]), (None, [])], "k_form string, k_labels array<string>")
    either = F.col("form").isNull() | F.col("k_form").isNull() | (F.col("form") == F.col("k_form")) | ((F.col("form") == "set") & (F.col("k_form") == "plain"))
    labels = (F.size("labels") == 0) | (F.size("k_labels") == 0) | F.arrays_overlap("labels", "k_labels")
    return p.crossJoin(F.broadcast(k)).select("p_partkey", F.coalesce("k_form", F.lit("any")).alias("wanted"), (F.coalesce(either, F.lit(True)) & labels).alias("fits"))


@query("flt14_decision_cascade", """select p_partkey, case when p_name like '%ring%' then 'DROP' when p_type = 'PROMO' then 'REVIEW' when p_size < 5 then 'REVIEW' else 'KEEP' end as status,
case when p_name like '%ring%' then 'R1' when p_type = 'PROMO' then 'R2' when p_size < 5 then 'R3' else 'R0' end as rule from part""")
def _(c):
    rules = [(F.col("p_name").contains("ring"), "DROP", "R1"), (F.col("p_type") == "PROMO", "REVIEW", "R2"), (F.col("p_size") < 5, "REVIEW", "R3")]
    decided = F.struct(F.lit("KEEP").alias("status"), F.lit("R0").alias("rule"))
    for test, status, rule in reversed(rules):  # the first rule that holds decides
        decided = F.when(test, F.struct(F.lit(status).alias("status"), F.lit(rule).alias("rule"))).otherwise(decided)
    return c.table("part").select("p_partkey", decided.alias("d")).select("p_partkey", "d.*")


@query("flt15_two_pass_override", """with f as (select p_partkey, case when p_type = 'PROMO' then 'REVIEW' else 'KEEP' end as status from part), s as (select p_partkey, case when p_size > 25 then 'KEEP' else 'DROP' end as second from part where p_type = 'PROMO' and p_size <> 25)
select p_partkey, case when status = 'REVIEW' then coalesce(second, status) else status end as final, case when status = 'REVIEW' and second is not null then 'second pass' else 'first pass' end as basis from f left join s using (p_partkey)""")
def _(c):
    first = c.table("part").select("p_partkey", F.when(F.col("p_type") == "PROMO", "REVIEW").otherwise("KEEP").alias("status"))
    second = c.table("part").filter("p_type = 'PROMO' and p_size <> 25").select("p_partkey", F.when(F.col("p_size") > 25, "KEEP").otherwise("DROP").alias("second"))
    over = (F.col("status") == "REVIEW") & F.col("second").isNotNull()
    return first.join(second, "p_partkey", "left").select("p_partkey", F.when(over, F.col("second")).otherwise(F.col("status")).alias("final"), F.when(over, "second pass").otherwise("first pass").alias("basis"))


@query("flt16_unclassified_drop", twin("pop", "select grp as label, count(*) as n, round(avg(people), 4) as mean_people from pop where grp <> 'ASIA' group by 1"))
def _(c):
    return c.pop.filter("grp <> 'ASIA'").groupBy(F.col("grp").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("people"), 4).alias("mean_people"))
