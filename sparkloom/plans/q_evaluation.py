"""Retrieval evaluation: the blended similarity's lists against co-ordered partners as relevant items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, ranking
from ..operators.sampling import hash_split
from .catalogue import twin
from .q_similarity import BLEND, lists, profiles
from .registry import query

_REL = ", rel as (select u as q, v as item, up - down as net from pair where up >= 5 and up > down union all select v, u, up - down from pair where up >= 5 and up > down)"
_EL = BLEND + _REL + ", eq as (select q, count(*) as n from rel group by 1 having count(*) >= 2)"


def relevant(c):
    trusted = c.pair.filter("up >= 5 and up > down")
    net = (F.col("up") - F.col("down")).alias("net")
    return trusted.select(F.col("u").alias("q"), F.col("v").alias("item"), net).unionByName(trusted.select(F.col("v").alias("q"), F.col("u").alias("item"), net))


def popularity(c, k: int = 10):
    """The first k of the same list for every query, without the query: k + 1 items stand for all, whatever their number."""
    best = c.pop.select("item", "people").orderBy(F.desc("people"), "item").limit(k + 1)
    row = F.array_sort(F.collect_list(F.struct((-F.col("people")).alias("less"), "item")))
    best = best.agg(row.alias("r")).select(F.posexplode("r").alias("pos", "r")).select((F.col("pos") + 1).alias("place"), F.col("r.item").alias("item"))
    own = best.select(F.col("item").alias("q"), F.col("place").alias("own"))
    rows = c.pop.select(F.col("item").alias("q")).join(F.broadcast(own), "q", "left").crossJoin(F.broadcast(best)).filter(F.col("q") != F.col("item"))
    rank = F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0)
    return rows.select("q", "item", rank.alias("rank")).filter(F.col("rank") <= k)


@query("evl01_relevant_pairs", twin("edge pair", _REL.replace(", rel", ", rel", 1) + " select q, item from rel"))
def _(c):
    return evaluate.relevant_pairs(c.pair.filter("up >= 5 and up > down"))


_BUCKET = "cast(('0x' || substr(md5(cast(q as varchar)), 1, 6)) as bigint) % 100"


@query("evl02_eligible_split", twin("edge pair", _REL + f" select q, n_rel, case when {_BUCKET} < 70 then 'dev' else 'test' end as part from (select q, count(*) as n_rel from rel group by 1 having count(*) >= 2)"))
def _(c):
    return relevant(c).groupBy("q").agg(F.count("*").alias("n_rel")).filter("n_rel >= 2").withColumn("part", hash_split("q", {"dev": 70, "test": 30}))


_METRIC_SQL = """, pl as (select q.item as q, p.item as item, row_number() over (partition by q.item order by p.people desc, p.item) as rank from pop q join pop p on p.item <> q.item),
runs as (select 'blend' as method, q, item, rank from lists union all select 'popularity', q, item, rank from pl), nr as (select q, count(*) as n_rel from rel group by 1), ks(k) as (values (5), (10)),
hits as (select r.method, r.q, r.rank from runs r join rel using (q, item)), qs as (select distinct method, q from runs join nr using (q)),
mt as (select qs.method, qs.q, k, n_rel, count(rank) filter (where rank <= k) as found, coalesce(max(1.0 / rank) filter (where rank <= k), 0) as mrr, coalesce(sum(1 / log2(rank + 1)) filter (where rank <= k), 0) as dcg from qs join nr on nr.q = qs.q cross join ks left join hits h on h.method = qs.method and h.q = qs.q group by 1, 2, 3, 4),
me as (select method, q, k, found / n_rel as recall, found / k as precision, case when found > 0 then 1 else 0 end as hit, mrr, dcg / list_sum(list_transform(generate_series(1, least(n_rel, k)), lambda i: 1 / log2(i + 1))) as ndcg from mt)"""


def measured(c):
    # No measure looks beyond the tenth place, so no list is ranked beyond it.
    runs = lists(c, 10).select(F.lit("blend").alias("method"), "q", "item", "rank").unionByName(popularity(c).select(F.lit("popularity").alias("method"), "q", "item", "rank"))
    return evaluate.metrics(runs, relevant(c), [5, 10], ("method",))


@query("evl03_ir_metrics", twin("feat tok edge pair pop", BLEND + _REL + _METRIC_SQL + " select method, k, count(*) as n, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(hit), 6) as hit, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg from me group by 1, 2"))
def _(c):
    return measured(c).groupBy("method", "k").agg(F.count("*").alias("n"), *[F.round(F.avg(x), 6).alias(x) for x in ("recall", "precision", "hit", "mrr", "ndcg")])


_GAINS = ", gn as (select q, item, case when net >= 8 then 3 when net >= 5 then 2 else 1 end as gain from rel)"


def gains(c):
    return relevant(c).select("q", "item", F.when(F.col("net") >= 8, 3).when(F.col("net") >= 5, 2).otherwise(1).alias("gain"))


@query("evl04_graded_ndcg", twin("feat tok edge pair", BLEND + _REL + _GAINS + " select q, round(sum(coalesce(2 ** gain - 1, 0) / log2(rank + 1)) / (7 * list_sum(list_transform(generate_series(1, 5), lambda i: 1 / log2(i + 1)))), 6) as ndcg from lists left join gn using (q, item) where rank <= 5 group by q"))
def _(c):
    return evaluate.graded_ndcg(lists(c, 5).select("q", "item", "rank"), gains(c), 5, 3).select("q", F.round("ndcg", 6).alias("ndcg"))


@query("evl05_linear_ndcg", twin("feat tok edge pair", BLEND + _REL + _GAINS + " select q, round(sum(coalesce(gain, 0) / log2(rank + 1)) / (3 * list_sum(list_transform(generate_series(1, 5), lambda i: 1 / log2(i + 1)))), 6) as ndcg from lists left join gn using (q, item) where rank <= 5 group by q"))
def _(c):
    ranked = lists(c, 5).select("q", "item", "rank")
    return evaluate.linear_ndcg(ranked, gains(c), ranked.select("q").distinct().withColumn("n_wanted", F.lit(3)), 5).select("q", F.round("ndcg", 6).alias("ndcg"))


@query("evl06_pooled_ndcg", twin("feat tok edge pair", BLEND + _REL + _GAINS + """, po as (select q, list_slice(list_reverse_sort(list(gain)), 1, 10) as best from gn group by 1), dc as (select q, sum(coalesce(gain, 0) / log2(rank + 1)) as dcg from lists left join gn using (q, item) where rank <= 10 group by q)
select q, round(dcg / list_sum(list_transform(best, lambda g, i: g / log2(i + 1))), 6) as ndcg from dc join po using (q)"""))
def _(c):
    return evaluate.pooled_ndcg(lists(c, 10).select("q", "item", "rank"), gains(c), 10).select("q", F.round("ndcg", 6).alias("ndcg"))


@query("evl07_strict_loose", twin("feat tok edge pair", BLEND + _REL + """, x as (select q, item, rank, (coalesce(net, 0) >= 5)::int + (sim >= 0.5)::int + (item in (select item from feat where feature like '%PROMO'))::int as met from lists left join rel using (q, item))
select q, round(count(*) filter (where rank <= 5 and met = 3) / 5, 6) as p5_strict, round(count(*) filter (where rank <= 5 and met >= 2) / 5, 6) as p5_loose, round(coalesce(max(1.0 / rank) filter (where met >= 2), 0), 6) as rr, round(5 * count(*) filter (where met = 3) / count(*), 6) as random_at5 from x group by q"""))
def _(c):
    # A list's rows are not made beyond its fifth: all three conditions need a relevant item, and the first row that meets two
    # is the best relevant or the best promoted one, whose place is counted.
    promo = c.feat.filter(F.col("feature").endswith("PROMO")).select("item").distinct()
    flag = promo.withColumn("promo", F.lit(1))
    p = profiles(c, marked=promo)
    net = relevant(c)
    met = (F.coalesce("net", F.lit(0)) >= 5).cast("int") + (F.col("sim") >= 0.5).cast("int") + F.coalesce("promo", F.lit(0))
    known = p.sims(net).join(net, ["q", "item"]).join(flag, "item", "left").withColumn("met", met)
    two = known.filter("met >= 2").select("q", "item", "sim").unionByName(p.lists(1, marked=True).filter("sim >= 0.5").select("q", "item", "sim"))
    first = ranking.first_by(two, ["q"], [F.desc("sim"), "item"])
    place = p.ranks(first).join(first.select("q", F.lit(True).alias("any")), "q", "left")
    all_three = known.filter("met = 3").groupBy("q").agg(F.count("*").alias("strict"))
    top = p.lists(5).select("q", "item", "sim").join(net, ["q", "item"], "left").join(flag, "item", "left").withColumn("met", met)
    at5 = top.groupBy("q").agg(F.count_if(F.col("met") == 3).alias("s5"), F.count_if(F.col("met") >= 2).alias("l5"))
    return place.join(at5, "q").join(all_three, "q", "left").select(
        "q", F.round(F.col("s5") / 5, 6).alias("p5_strict"), F.round(F.col("l5") / 5, 6).alias("p5_loose"),
        F.round(F.when(F.col("any"), 1.0 / F.col("rank")).otherwise(0.0), 6).alias("rr"), F.round(5 * F.coalesce("strict", F.lit(0)) / F.col("n"), 6).alias("random_at5"))


_FOLD = "cast(('0x' || substr(md5(cast(q as varchar) || '/7'), 1, 6)) as bigint) % 5"


def folded(c):
    return measured(c).withColumn("fold", F.conv(F.substring(F.md5(F.concat(F.col("q").cast("string"), F.lit("/7"))), 1, 6), 16, 10).cast("long") % 5)


@query("evl08_folds", twin("feat tok edge pair pop", BLEND + _REL + _METRIC_SQL + f", f as (select method, k, {_FOLD} as fold, avg(ndcg) as m from me group by 1, 2, 3) select method, k, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd from f group by 1, 2"))
def _(c):
    return evaluate.fold_summary(folded(c), "fold", "ndcg", ["method", "k"]).select("method", "k", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("evl09_paired_bootstrap", twin("feat tok edge pair pop", BLEND + _REL + _METRIC_SQL + " select round(avg(b.ndcg - p.ndcg), 6) as mean, true as ordered from me b join me p on b.q = p.q and b.k = 10 and p.k = 10 and b.method = 'blend' and p.method = 'popularity'"))
def _(c):
    m = measured(c).filter("k = 10").groupBy("q").pivot("method", ["blend", "popularity"]).agg(F.first("ndcg"))
    ci = evaluate.paired_bootstrap(m.select(F.col("q").alias("id"), (F.col("blend") - F.col("popularity")).alias("diff")), 200)
    return ci.select(F.round("mean", 6).alias("mean"), ((F.col("low") <= F.col("mean")) & (F.col("mean") <= F.col("high"))).alias("ordered"))


@query("evl10_oracle_bound", twin("feat tok edge pair", BLEND + _REL + ", x as (select q, item, rank, net is not null as good from lists left join rel using (q, item) where rank <= 30) select q, item, row_number() over (partition by q order by good desc, rank) as rank from x"))
def _(c):
    x = lists(c, 30).select("q", "item", F.col("rank").alias("old")).join(relevant(c).select("q", "item", F.lit(True).alias("good")), ["q", "item"], "left")
    return ranking.row_rank(x, ["q"], [F.desc(F.coalesce("good", F.lit(False))), "old"]).select("q", "item", "rank")


@query("evl11_best_row", twin("feat tok edge pair pop", BLEND + _REL + _METRIC_SQL + " , s as (select method, k, round(avg(ndcg), 6) as ndcg, round(avg(recall), 6) as recall from me group by 1, 2) select * from s order by ndcg desc, recall desc, k, method limit 1"))
def _(c):
    s = measured(c).groupBy("method", "k").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("recall"), 6).alias("recall"))
    return s.orderBy(F.desc("ndcg"), F.desc("recall"), "k", "method").limit(1)


@query("evl12_explainable", twin("feat tok edge pair", BLEND + ", k as (select q, item from lists where rank <= 10) select round(avg(case when exists (select 1 from tok a join tok b using (token) where a.item = k.q and b.item = k.item) then 1.0 else 0 end), 6) as share_note, count(*) as pairs from k"))
def _(c):
    return profiles(c).lists(10).agg(F.round(F.avg(F.col("note").cast("double")), 6).alias("share_note"), F.count("*").alias("pairs"))


@query("evl13_partner_hit", twin("feat tok edge pair", _EL + ", t as (select q, count(*) as found from lists join rel using (q, item) where rank <= 10 group by 1) select round(avg(coalesce(found, 0) / n), 6) as hit from eq left join t using (q)"))
def _(c):
    n = relevant(c).groupBy("q").agg(F.count("*").alias("n")).filter("n >= 2")
    found = lists(c, 10).join(relevant(c).select("q", "item"), ["q", "item"]).groupBy("q").agg(F.count("*").alias("found"))
    return n.join(found, "q", "left").agg(F.round(F.avg(F.coalesce("found", F.lit(0)) / F.col("n")), 6).alias("hit"))


_LABELS = "with g as (select p_partkey, p_brand, string_split(p_name, ' ') as gold, [string_split(p_name, ' ')[1], case when p_size % 3 = 0 then string_split(p_name, ' ')[2] else 'none' end] as said from part)"


def labelled(c):
    w = F.split("p_name", " ")
    return c.table("part").select("p_partkey", "p_brand", w.alias("gold"), F.array(w[0], F.when(F.col("p_size") % 3 == 0, w[1]).otherwise("none")).alias("said"))


@query("evl14_multilabel_prf", _LABELS + ", s as (select p_brand, sum(len(list_intersect(gold, said))) as tp, sum(len(list_distinct(said)) - len(list_intersect(gold, said))) as fp, sum(len(list_distinct(gold)) - len(list_intersect(gold, said))) as fn from g group by 1) select p_brand, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from s")
def _(c):
    return evaluate.micro_prf(labelled(c), "gold", "said", ["p_brand"]).select("p_brand", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("evl15_fuzzy_one_to_one")
def _(c):
    from ..functions.matching import fuzzy_pairs

    return labelled(c).select("p_partkey", F.size(fuzzy_pairs("gold", "said")).alias("matched"))


@query("evl16_maximum_matching")
def _(c):
    from ..functions.matching import maximum_pairs

    return labelled(c).select("p_partkey", maximum_pairs("gold", "said").alias("most"))


@query("evl17_coverage", _LABELS + " select p_partkey, len(list_filter(gold, lambda g: len(list_filter(said, lambda s: contains(g, s) or contains(s, g))) > 0)) as covered from g")
def _(c):
    hit = F.filter("gold", lambda g: F.exists("said", lambda s: g.contains(s) | s.contains(g)))
    return labelled(c).select("p_partkey", F.size(hit).alias("covered"))


@query("evl18_exact_match", _LABELS + " select p_brand, round(avg(case when list_sort(gold) = list_sort(said) then 1.0 else 0 end), 6) as exact, round(avg(case when gold[1] = said[1] then 1.0 else 0 end), 6) as first from g group by 1")
def _(c):
    share = lambda e, n: F.round(F.avg(e.cast("double")), 6).alias(n)
    return labelled(c).groupBy("p_brand").agg(share(F.array_sort("gold") == F.array_sort("said"), "exact"), share(F.col("gold")[0] == F.col("said")[0], "first"))


_ANN = "with an as (select p_name as q, p_brand as annotator, list_sort(list(distinct p_type)) as labels from part group by 1, 2)"


@query("evl19_agreement_of_all", _ANN + " select a.q, count(*) as pairs, round(avg(len(list_intersect(a.labels, b.labels)) / len(list_distinct(list_concat(a.labels, b.labels)))), 6) as agreement, round(avg(len(list_intersect(a.labels, b.labels)) / len(list_distinct(list_concat(a.labels, b.labels)))), 6) >= 0.3 as enough from an a join an b on a.q = b.q and a.annotator < b.annotator group by 1")
def _(c):
    an = c.table("part").groupBy(F.col("p_name").alias("q"), F.col("p_brand").alias("annotator")).agg(F.collect_set("p_type").alias("labels"))
    other = an.select("q", F.col("annotator").alias("b"), F.col("labels").alias("lb"))
    union = F.size(F.array_union("labels", "lb"))
    j = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("labels", "lb")) / union)
    agreed = an.join(other, "q").filter("annotator < b").groupBy("q").agg(F.count("*").alias("pairs"), F.round(F.avg(j), 6).alias("agreement"))
    return agreed.withColumn("enough", F.col("agreement") >= 0.3)


@query("evl20_annotation_issues", "select doc_id, array_to_string(list_filter([case when quality not in (0, 1) then 'BAD_QUALITY' end, case when quality = 0 and toxic = 1 then 'TOXIC_BAD' end, case when n > 1 then 'DUPLICATE' end], lambda x: x is not null), ',') as issues from (select *, count(*) over (partition by doc_id) as n from labels)")
def _(c):
    rows = c.table("labels").withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    codes = F.array(F.when(~F.col("quality").isin(0, 1), "BAD_QUALITY"), F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "TOXIC_BAD"), F.when(F.col("n") > 1, "DUPLICATE"))
    return rows.select("doc_id", F.array_join(F.array_compact(codes), ",").alias("issues"))


_FOUND = BLEND + _REL + ", fr as (select rel.q, min(rank) as best, max(sim) as top from rel left join lists using (q, item) group by 1)"


def first_found(c):
    """(q, best, top): each query's first relevant item's place in the whole list, and its similarity; null where none is in it."""
    p, rel = profiles(c), relevant(c).select("q", "item")
    first = ranking.first_by(p.sims(rel), ["q"], [F.desc("sim"), "item"])
    place = first.join(p.ranks(first), "q").select("q", F.col("rank").alias("best"), F.col("sim").alias("top"))
    return rel.select("q").distinct().join(place, "q", "left")


@query("evl21_retrieval_confirmation", twin("feat tok edge pair", _FOUND + " select round(avg(case when best <= 1 then 1.0 else 0 end), 6) as r1, round(avg(case when best <= 5 then 1.0 else 0 end), 6) as r5, round(avg(coalesce(1.0 / best, 0)), 6) as mrr, count(*) filter (where top >= 0.6) as confirmed, round(count(*) filter (where top >= 0.6 and best <= 1) / nullif(count(*) filter (where top >= 0.6), 0), 6) as auto_precision from fr"))
def _(c):
    f = first_found(c)
    upto = lambda k: F.round(F.avg(F.coalesce(F.col("best") <= k, F.lit(False)).cast("double")), 6)
    sure = F.col("top") >= 0.6
    n = F.count_if(sure)
    return f.agg(upto(1).alias("r1"), upto(5).alias("r5"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"), n.alias("confirmed"), F.round(F.when(n > 0, F.count_if(sure & (F.col("best") <= 1)) / n), 6).alias("auto_precision"))


_BASE = ", pl as (select q.item as q, p.item as item, row_number() over (partition by q.item order by p.people desc, p.item) as rank from pop q join pop p on p.item <> q.item), fp as (select rel.q, min(rank) as base from rel left join pl using (q, item) group by 1)"


@query("evl22_rescue_regression", twin("feat tok edge pair pop", _FOUND + _BASE + " select case when coalesce(base <= 5, false) = coalesce(best <= 5, false) then 'same' when coalesce(best <= 5, false) then 'rescue' else 'regression' end as change, count(*) as n from fr join fp using (q) group by 1"))
def _(c):
    base = relevant(c).join(popularity(c), ["q", "item"], "left").groupBy("q").agg(F.min("rank").alias("base"))
    was, now = F.coalesce(F.col("base") <= 5, F.lit(False)), F.coalesce(F.col("best") <= 5, F.lit(False))
    return first_found(c).join(base, "q").groupBy(F.when(was == now, "same").when(now, "rescue").otherwise("regression").alias("change")).agg(F.count("*").alias("n"))


@query("evl23_miss_causes", twin("feat tok edge pair pop", BLEND + _REL + ", cand as (select p.item, p.brand from pop p where people >= 320) select case when l.rank <= 10 then 'FOUND' when c.item is null then 'CATALOG_MISSING' when c.brand = o.brand then 'BRAND_BLOCKED' when l.rank is not null then 'IN_POOL' else 'FILTER' end as cause, count(*) as n from rel left join lists l using (q, item) left join cand c on c.item = rel.item join pop o on o.item = rel.q group by 1"))
def _(c):
    cand = c.pop.filter("people >= 320").select("item", F.col("brand").alias("cb"))
    own = c.pop.select(F.col("item").alias("q"), F.col("brand").alias("ob"))
    p, rel = profiles(c), relevant(c).select("q", "item")
    found = p.sims(rel).join(p.lists(10).select("q", "item", "rank"), ["q", "item"], "left").withColumn("listed", F.lit(True))
    rows = rel.join(found, ["q", "item"], "left").join(cand, "item", "left").join(own, "q")
    cause = F.when(F.col("rank") <= 10, "FOUND").when(F.col("cb").isNull(), "CATALOG_MISSING").when(F.col("cb") == F.col("ob"), "BRAND_BLOCKED").when(F.col("listed"), "IN_POOL").otherwise("FILTER")
    return rows.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("evl24_pareto", twin("pop votes", ", m as (select brand, sum(people)::bigint as a, sum(q1)::bigint as b, sum(night)::bigint as d from pop join votes using (item) group by 1) select brand, a, b, d from m where not exists (select 1 from m o where o.a >= m.a and o.b >= m.b and o.d >= m.d and (o.a > m.a or o.b > m.b or o.d > m.d))"))
def _(c):
    m = c.pop.join(c.votes, "item").groupBy("brand").agg(F.sum("people").alias("a"), F.sum("q1").alias("b"), F.sum("night").alias("d"))
    return evaluate.pareto_front(m, ["a", "b", "d"])


@query("evl25_stratified", twin("feat tok edge pair pop", BLEND + _REL + _METRIC_SQL + " select grp, method, round(avg(ndcg), 6) as ndcg, count(*) as n from me join pop on item = q where k = 10 group by 1, 2"))
def _(c):
    return measured(c).filter("k = 10").join(c.pop.select(F.col("item").alias("q"), "grp"), "q").groupBy("grp", "method").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count("*").alias("n"))
