"""Operators that one or two analyses need: audits, variants, gates and lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hangul
from ..functions import text as tx
from ..operators import evaluate, ranking, recommend
from ..operators.geometry import agglomerative_by_label, points
from ..operators.sampling import hash_key
from .catalogue import twin
from .q_aggregates import _FAMILY, family_score
from .q_evaluation import _LABELS, labelled
from .q_filters import _HAS, REQUESTS_SQL, has, requests
from .q_joins import _LIFT, lift
from .q_recommend import _CAND, searched
from .q_similarity import BLEND, profiles
from .q_text import _HITS, hits, lexicon
from .registry import query


@query("xtr01_coverage_cut", "with g as (select p_name, count(*) as n from part group by 1), c as (select p_name, row_number() over (order by n desc, p_name) as rn, sum(n) over (order by n desc, p_name rows unbounded preceding) / sum(n) over () as cum from g) select least(min(rn) filter (where cum >= 0.8), 200) as terms from c")
def _(c):
    g = c.table("part").groupBy("p_name").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "p_name")  # over the vocabulary, which is small
    cum = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = g.select(F.row_number().over(w).alias("rn"), cum.alias("cum")).crossJoin(F.broadcast(g.agg(F.sum("n").alias("total"))))
    return rows.agg(F.least(F.min(F.when(F.col("cum") / F.col("total") >= 0.8, F.col("rn"))), F.lit(200)).cast("long").alias("terms"))


@query("xtr02_source_contribution", "with o as (select p_name, count(*) as n from part group by 1), s as (select p_name, case when p_name like 'red%' then 'dictionary' when p_name like '%ring' then 'reviewed' else 'unmapped' end as source, n from o) select source, sum(n)::bigint as occurrences, round(sum(n) / (select sum(n) from o), 6) as share from s group by 1")
def _(c):
    o = c.table("part").groupBy("p_name").agg(F.count("*").alias("n"))
    source = F.when(F.col("p_name").startswith("red"), "dictionary").when(F.col("p_name").endswith("ring"), "reviewed").otherwise("unmapped")
    total = F.broadcast(o.agg(F.sum("n").alias("total")))
    return o.groupBy(source.alias("source")).agg(F.sum("n").alias("occurrences")).crossJoin(total).select("source", "occurrences", F.round(F.col("occurrences") / F.col("total"), 6).alias("share"))


@query("xtr03_material_base", "select regexp_extract(p_name, '^(.*) (ring|bolt|gear|widget)$', 1) as base, string_agg(distinct split_part(p_name, ' ', 2), '|' order by split_part(p_name, ' ', 2)) as materials from part where regexp_matches(p_name, ' (ring|bolt|gear|widget)$') group by 1")
def _(c):
    base = F.regexp_extract("p_name", "^(.*) (ring|bolt|gear|widget)$", 1)
    rows = c.table("part").filter(F.col("p_name").rlike(" (ring|bolt|gear|widget)$"))
    return rows.groupBy(base.alias("base")).agg(F.array_join(F.array_sort(F.collect_set(F.split_part("p_name", F.lit(" "), F.lit(2)))), "|").alias("materials"))


@query("xtr04_singular_forms", "select distinct split_part(p_name, ' ', 2) as word, case when p_name like '%e' then 4 else 3 end::bigint as forms from part")
def _(c):
    w = c.table("part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word")).distinct()
    low = F.concat("word", F.lit("s"))
    forms = F.array_distinct(F.array_compact(F.array(low, F.regexp_replace(low, "s$", ""), F.when(low.rlike("es$"), F.regexp_replace(low, "es$", "")), F.concat("word", F.lit("y")))))
    return w.select("word", F.size(forms).cast("long").alias("forms"))


@query("xtr05_decision_evidence", "with e as (select p_type, count(*) filter (where p_size > 40) as n from part group by 1), d(p_type, decision) as (values ('PROMO', 'drop'), ('LARGE', 'keep')) select p_type, coalesce(decision, 'open') as decision, n as evidence, n >= 60 as confident from e left join d using (p_type)")
def _(c):
    d = c.frame([("PROMO", "drop"), ("LARGE", "keep")], "p_type string, decision string")
    e = c.table("part").groupBy("p_type").agg(F.count_if(F.col("p_size") > 40).alias("n"))
    return e.join(F.broadcast(d), "p_type", "left").select("p_type", F.coalesce("decision", F.lit("open")).alias("decision"), F.col("n").alias("evidence"), (F.col("n") >= 60).alias("confident"))


def _and_sets(c, which):
    wanted = F.broadcast(requests(c).select("q", F.explode(which).alias("feature"), F.size(which).alias("n")))
    return c.feat.join(wanted, "feature").groupBy("q", "item", "n").agg(F.count("*").alias("met")).filter("met = n").select("q", "item")


@query("xtr06_variant_overlap", twin("feat", REQUESTS_SQL + _HAS + ", a as (select q, item from req, has where list_has_all(f, core)), b as (select q, item from req, has where list_contains(f, core[1])) select b.q, round(count(a.item) / count(*), 6) as jaccard from b left join a on a.q = b.q and a.item = b.item group by 1"))
def _(c):
    whole = _and_sets(c, "core").withColumn("a", F.lit(1))
    first = c.feat.join(F.broadcast(requests(c).select("q", F.col("core")[0].alias("feature"))), "feature").select("q", "item")
    return first.join(whole, ["q", "item"], "left").groupBy("q").agg(F.round(F.count("a") / F.count("*"), 6).alias("jaccard"))


@query("xtr07_core_optional", twin("feat", REQUESTS_SQL + ", s as (select q, item, round(sum(strength), 4) as score, max(case when feature = core[1] then 1 else 0 end) as has_core from req join feat on list_contains(core, feature) group by 1, 2) select q, item, rank from (select *, row_number() over (partition by q order by score desc, item) as rank from s where has_core = 1) where rank <= 5"))
def _(c):
    w = F.broadcast(requests(c).select("q", F.explode("core").alias("feature"), F.col("core")[0].alias("must")))
    s = c.feat.join(w, "feature").groupBy("q", "item").agg(F.round(F.sum("strength"), 4).alias("score"), F.max((F.col("feature") == F.col("must")).cast("int")).alias("has_core")).filter("has_core = 1")
    return ranking.top_n(s, ["q"], [F.desc("score"), "item"], 5).select("q", "item", "rank")


@query("xtr08_rules_of_all", "with r as (select p_name || '/' || p_size as entry, p_type as cond, count(distinct p_brand) as core from part group by 1, 2) select entry, cond, core from r where core < 2 and cond <> 'PROMO'")
def _(c):
    entry = F.concat_ws("/", "p_name", "p_size").alias("entry")
    r = c.table("part").groupBy(entry, F.col("p_type").alias("cond")).agg(F.count_distinct("p_brand").alias("core"))
    return r.filter("core < 2 and cond <> 'PROMO'")


@query("xtr09_multilabel_typing", "select p_partkey, array_to_string(list_filter([case when contains(p_name, 'ring') then 'round' end, case when regexp_matches(p_name, '^(red|blue)') then 'colour' end, case when p_size > 40 then 'big' end], lambda x: x is not null), '+') as labels, case when regexp_matches(p_name, '^(red|blue)') then 'A' when contains(p_name, 'ring') or p_size > 40 then 'B' else 'C' end as bucket from part")
def _(c):
    p = c.table("part").withColumn("labels", F.array_compact(F.array(F.when(F.col("p_name").contains("ring"), "round"), F.when(F.col("p_name").rlike("^(red|blue)"), "colour"), F.when(F.col("p_size") > 40, "big"))))
    bucket = F.when(F.array_contains("labels", "colour"), "A").when(F.size("labels") > 0, "B").otherwise("C")
    return p.select("p_partkey", F.array_join("labels", "+").alias("labels"), bucket.alias("bucket"))


@query("xtr10_zero_causes", "with z as (select 1)" + _HITS + " select case when s.p_partkey is null then 'none extracted' else 'extracted, unmapped' end as cause, count(*) as n from part left join (select distinct p_partkey from part, sf where contains(p_name, surface)) s using (p_partkey) where p_partkey not in (select p_partkey from ht) group by 1")
def _(c):
    seen = c.table("part").join(F.broadcast(lexicon(c)), F.col("p_name").contains(F.col("surface"))).select("p_partkey").distinct().withColumn("seen", F.lit(1))
    left = c.table("part").join(hits(c), "p_partkey", "left_anti").join(seen, "p_partkey", "left")
    return left.groupBy(F.when(F.col("seen").isNull(), "none extracted").otherwise("extracted, unmapped").alias("cause")).agg(F.count("*").alias("n"))


@query("xtr11_intake_checks", "select conv_id, count(*) <> 2 as wrong_count, bool_or(length(text) > 1000) as any_long, count(*) - count(distinct text) as duplicates, bool_or(regexp_matches(text, '[0-9]')) as any_digit from conversations group by 1")
def _(c):
    return c.table("conversations").groupBy("conv_id").agg((F.count("*") != 2).alias("wrong_count"), F.bool_or(F.char_length("text") > 1000).alias("any_long"), (F.count("*") - F.count_distinct("text")).alias("duplicates"), F.bool_or(F.col("text").rlike("[0-9]")).alias("any_digit"))


@query("xtr12_text_profile", "select lang, count(*) as n, round(avg(length(text)), 4) as mean_chars, max(length(text)) as longest, round(avg(len(string_split(text, '. '))), 4) as mean_clauses, round(avg(case when regexp_matches(text, '[|#$%]') then 1.0 else 0 end), 6) as odd_share from documents group by 1")
def _(c):
    return c.table("documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg(F.char_length("text")), 4).alias("mean_chars"), F.max(F.char_length("text")).cast("long").alias("longest"),
        F.round(F.avg(F.size(F.split("text", r"\. "))), 4).alias("mean_clauses"), F.round(F.avg(F.col("text").rlike("[|#$%]").cast("double")), 6).alias("odd_share"))


@query("xtr13_dictionary_variants", "select p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x not in ('hot', 'ring')), '|') as surfaces, case when p_size % 2 = 0 and (contains(p_name, 'hot') or contains(p_name, 'ring')) then 'needs: bolt' else '' end as cond from part")
def _(c):
    drop = F.array(F.lit("hot"), F.lit("ring"))
    p = c.table("part").select("p_partkey", "p_size", F.split("p_name", " ").alias("s"))
    return p.select("p_partkey", F.array_join(F.array_except("s", drop), "|").alias("surfaces"), F.when((F.col("p_size") % 2 == 0) & F.arrays_overlap("s", drop), "needs: bolt").otherwise("").alias("cond"))


@query("xtr14_relabel_variants", twin("feat pop", REQUESTS_SQL + ", v as (select 'A' as variant, q, core, avoid from req union all select 'B', q, list_transform(core, lambda x: replace(x, 'SMALL', 'LARGE')), avoid from req) select variant, q, count(distinct item) as reach from v join feat on list_contains(core, feature) group by 1, 2"))
def _(c):
    r = requests(c)
    b = r.withColumn("core", F.transform("core", lambda x: F.replace(x, F.lit("SMALL"), F.lit("LARGE"))))
    v = r.withColumn("variant", F.lit("A")).unionByName(b.withColumn("variant", F.lit("B")))
    return c.feat.join(F.broadcast(v.select("variant", "q", F.explode("core").alias("feature"))), "feature").groupBy("variant", "q").agg(F.count_distinct("item").alias("reach"))


@query("xtr15_performance_filter", twin("feat pop votes", REQUESTS_SQL + _CAND + ", j as (select q, item, score, night from cd join votes using (item)) select 'mask' as mode, q, item, row_number() over (partition by q order by score desc, item) as rank from j where night >= 300 union all select 'sort', q, item, row_number() over (partition by q order by score desc, night desc, item) from j"))
def _(c):
    j = recommend.candidates(requests(c), c.feat, c.pop).join(c.votes.select("item", "night"), "item")
    mask = ranking.row_rank(j.filter("night >= 300"), ["q"], [F.desc("score"), "item"]).withColumn("mode", F.lit("mask"))
    order = ranking.row_rank(j, ["q"], [F.desc("score"), F.desc("night"), "item"]).withColumn("mode", F.lit("sort"))
    return mask.unionByName(order).select("mode", "q", "item", "rank")


@query("xtr16_repeatability", "select p_name, count(distinct (p_type, p_size % 2)) as outcomes from part group by 1")
def _(c):
    return c.table("part").groupBy("p_name").agg(F.count_distinct(F.struct("p_type", F.col("p_size") % 2)).alias("outcomes"))


@query("xtr17_length_histogram", "select length(w) as letters, count(*) as n from (select distinct unnest(string_split(p_name, ' ')) as w from part) group by 1")
def _(c):
    w = c.table("part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return w.groupBy(F.char_length("w").cast("long").alias("letters")).agg(F.count("*").alias("n"))


@query("xtr18_negation_audit", "select count(*) filter (where p_size % 4 = 0) as negated, count(*) filter (where p_size % 4 = 0 and p_name like 'hot%') as turned, count(*) filter (where p_name like 'hot%') as hard, count(*) filter (where p_name like '%ring') as soft from part")
def _(c):
    neg, hot = F.col("p_size") % 4 == 0, F.col("p_name").startswith("hot")
    return c.table("part").agg(F.count_if(neg).alias("negated"), F.count_if(neg & hot).alias("turned"), F.count_if(hot).alias("hard"), F.count_if(F.col("p_name").endswith("ring")).alias("soft"))


@query("xtr19_misfire_probe", "with z as (select 1)" + _HITS + " select split_part(p_name, ' ', 1) as word, feature, count(*) as n from ht group by 1, 2")
def _(c):
    return hits(c).groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"), "feature").agg(F.count("*").alias("n"))


@query("xtr21_greedy_cover", twin("feat pop", ", b as (select feature, item, people from (select *, row_number() over (partition by feature order by people desc, item) as r from feat join pop using (item)) where r = 1), c as (select distinct item from b), f as (select item, row_number() over (order by people desc, item) as r from pop where item not in (select item from c)) select item, 'cover' as why from c union all select item, 'fill' from f where r <= 10"))
def _(c):
    cover = ranking.first_by(c.feat.join(c.pop, "item"), ["feature"], [F.desc("people"), "item"]).select("item").distinct()
    fill = c.pop.join(cover, "item", "left_anti").orderBy(F.desc("people"), "item").limit(10)
    return cover.select("item", F.lit("cover").alias("why")).unionByName(fill.select("item", F.lit("fill").alias("why")))


@query("xtr22_edge_leak", twin("edge", ", tr as (select src, dst from edge where src % 2 = 0), ev as (select src, dst from edge where src % 2 = 1) select count(*) filter (where exists (select 1 from tr where tr.src = ev.src and tr.dst = ev.dst)) as directed, count(*) filter (where exists (select 1 from tr where least(tr.src, tr.dst) = least(ev.src, ev.dst) and greatest(tr.src, tr.dst) = greatest(ev.src, ev.dst))) as undirected from ev"))
def _(c):
    train, test = c.edge.filter("src % 2 = 0"), c.edge.filter("src % 2 = 1")
    ends = [F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")]
    directed = test.join(train, ["src", "dst"], "left_semi").agg(F.count("*").alias("directed"))
    return directed.crossJoin(test.select(*ends).join(train.select(*ends), ["u", "v"], "left_semi").agg(F.count("*").alias("undirected")))


@query("xtr23_seed_statistics", "with s as (select p_type as method, p_size as seed, avg(p_retailprice) as v from part group by 1, 2) select a.method, round(avg(a.v), 4) as mean, round(stddev_samp(a.v), 4) as sd, round(avg(a.v - b.v), 4) as delta from s a join s b on a.seed = b.seed and b.method = 'PROMO' group by 1")
def _(c):
    s = c.table("part").groupBy(F.col("p_type").alias("method"), F.col("p_size").alias("seed")).agg(F.avg("p_retailprice").alias("v"))
    base = s.filter("method = 'PROMO'").select("seed", F.col("v").alias("b"))
    return s.join(base, "seed").groupBy("method").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("sd"), F.round(F.avg(F.col("v") - F.col("b")), 4).alias("delta"))


@query("xtr24_linkages")
def _(c):
    out = None
    for linkage in ("average", "complete", "single"):
        sizes = agglomerative_by_label(points(c), 5, linkage).groupBy("label", "cluster").agg(F.count("*").alias("n")).groupBy("label").agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumn("linkage", F.lit(linkage))
        out = sizes if out is None else out.unionByName(sizes)
    return out


@query("xtr25_worst_pairs", "with pt as (select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, label from embeddings) select a.id as a, b.id as b, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 6) as d, a.x * b.x > 0 as same_side from pt a join pt b on a.label = b.label and a.id < b.id order by round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 6) desc, a, b limit 20")
def _(c):
    p = points(c)
    b = p.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "label")
    pairs = p.withColumnRenamed("id", "a").join(b, "label").filter("a < b").select("a", "b", F.round(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2), 6).alias("d"), (F.col("x") * F.col("bx") > 0).alias("same_side"))
    return pairs.orderBy(F.desc("d"), "a", "b").limit(20)


@query("xtr26_item_list", twin("pop votes tok", ", t as (select item, count(*) as notes from tok group by 1) select pop.item, name, brand, case greatest(q1, q2, q3, q4) when q1 then 'q1' when q2 then 'q2' when q3 then 'q3' else 'q4' end as season, case when night / (day + night) >= 0.55 then 'night' when day / (day + night) >= 0.55 then 'day' else 'any' end as part, coalesce(notes, 0) as notes from pop join votes using (item) left join t using (item)"))
def _(c):
    top = F.greatest("q1", "q2", "q3", "q4")
    season = F.when(top == F.col("q1"), "q1").when(top == F.col("q2"), "q2").when(top == F.col("q3"), "q3").otherwise("q4")
    dark = F.col("night") / (F.col("day") + F.col("night"))
    notes = c.tok.groupBy("item").agg(F.count("*").alias("notes"))
    return c.pop.join(c.votes, "item").join(notes, "item", "left").select("item", "name", "brand", season.alias("season"), F.when(dark >= 0.55, "night").when(1 - dark >= 0.55, "day").otherwise("any").alias("part"), F.coalesce("notes", F.lit(0)).alias("notes"))


@query("xtr27_pipeline_toggles", "with g(strict, human) as (values (false, false), (false, true), (true, false), (true, true)), r as (select strict, human, p_size % 5 <> 0 as truth, (p_size % 3 <> 0 or not strict) and (p_size % 7 <> 0 or not human) as said from part, g) select strict, human, count(*) filter (where said) as kept, round(count(*) filter (where said and truth) / count(*) filter (where said), 6) as precision from r group by 1, 2")
def _(c):
    g = F.broadcast(c.frame([(a, b) for a in (False, True) for b in (False, True)], "strict boolean, human boolean"))
    said = ((F.col("p_size") % 3 != 0) | ~F.col("strict")) & ((F.col("p_size") % 7 != 0) | ~F.col("human"))
    n = F.count_if(said)
    return c.table("part").crossJoin(g).groupBy("strict", "human").agg(n.alias("kept"), F.round(F.count_if(said & (F.col("p_size") % 5 != 0)) / n, 6).alias("precision"))


@query("xtr28_family_systems", twin("feat", ", m(system, family, target) as (values ('six', 'SMALL', 'SMALL'), ('six', 'LARGE', 'LARGE'), ('six', 'MEDIUM', 'MEDIUM'), ('merged', 'SMALL', 'SIZED'), ('merged', 'LARGE', 'SIZED'), ('merged', 'ECONOMY', 'PRICED')), f as (select system, target, sum(strength) as s from feat join m on m.family = split_part(feature, ' ', 2) group by 1, 2) select system, target, round(s, 2) as mass, round(1 - sum(s) over (partition by system) / (select sum(strength) from feat), 6) as lost from f"))
def _(c):
    m = F.broadcast(c.frame([("six", "SMALL", "SMALL"), ("six", "LARGE", "LARGE"), ("six", "MEDIUM", "MEDIUM"), ("merged", "SMALL", "SIZED"), ("merged", "LARGE", "SIZED"), ("merged", "ECONOMY", "PRICED")], "system string, family string, target string"))
    s = c.feat.withColumn("family", F.split_part("feature", F.lit(" "), F.lit(2))).join(m, "family").groupBy("system", "target").agg(F.sum("strength").alias("s"))
    total = F.broadcast(c.feat.agg(F.sum("strength").alias("total")))
    kept = F.sum("s").over(Window.partitionBy("system"))
    return s.crossJoin(total).select("system", "target", F.round("s", 2).alias("mass"), F.round(1 - kept / F.col("total"), 6).alias("lost"))


@query("xtr29_label_rule", twin("feat", _FAMILY + ", r as (select item, max(score) as top1, max(score) - coalesce(max(score) filter (where r = 2), 0) as margin from (select *, row_number() over (partition by item order by score desc, family) as r from sc) group by 1), t(t) as (values (0.2::double), (0.3::double), (0.4::double)) select t, round(avg(case when top1 >= t then 1.0 else 0 end), 6) as labelled, round(avg(case when margin < 0.05 then 1.0 else 0 end), 6) as close from r, t group by 1"))
def _(c):
    o = family_score(c).groupBy("item").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    r = o.select(F.col("s")[0].alias("top1"), (F.col("s")[0] - F.coalesce(F.try_element_at("s", F.lit(2)), F.lit(0.0))).alias("margin"))
    t = F.broadcast(c.frame([(0.2,), (0.3,), (0.4,)], "t double"))
    share = lambda e: F.round(F.avg(e.cast("double")), 6)
    return r.crossJoin(t).groupBy("t").agg(share(F.col("top1") >= F.col("t")).alias("labelled"), share(F.col("margin") < 0.05).alias("close"))


@query("xtr30_argmax_diff", twin("feat", _FAMILY + ", a as (select item, family, row_number() over (partition by item order by score desc, family) as r from sc), b as (select item, split_part(feature, ' ', 2) as family, row_number() over (partition by item order by strength desc, feature) as r from feat where feature not like '%PROMO') select a.family as fs1, b.family as fs2, count(*) as n from a join b using (item) where a.r = 1 and b.r = 1 and a.family <> b.family group by 1, 2"))
def _(c):
    a = ranking.first_by(family_score(c), ["item"], [F.desc("score"), "family"]).select("item", F.col("family").alias("fs1"))
    b = ranking.first_by(c.feat.filter(~F.col("feature").endswith("PROMO")), ["item"], [F.desc("strength"), "feature"]).select("item", F.split_part("feature", F.lit(" "), F.lit(2)).alias("fs2"))
    return a.join(b, "item").filter("fs1 <> fs2").groupBy("fs1", "fs2").agg(F.count("*").alias("n"))


@query("xtr31_seed_gates", "with s as (select p_type as candidate, p_size % 10 as seed, avg(p_retailprice) as v from part group by 1, 2) select candidate, count(*) filter (where v >= 950) as passed, round(min(v - 950), 4) as headroom from s group by 1")
def _(c):
    s = c.table("part").groupBy(F.col("p_type").alias("candidate"), F.col("p_size") % 10).agg(F.avg("p_retailprice").alias("v"))
    return s.groupBy("candidate").agg(F.count_if(F.col("v") >= 950).alias("passed"), F.round(F.min(F.col("v") - 950), 4).alias("headroom"))


@query("xtr32_audit_queues", _LABELS + " select p_partkey, array_to_string(list_filter([case when gold[1] <> said[1] then 'first' end, case when coalesce(gold[2], '') <> coalesce(said[2], '') then 'second' end], lambda x: x is not null), ',') as fields from g where list_sort(gold) <> list_sort(said)")
def _(c):
    rows = labelled(c).filter(F.array_sort("gold") != F.array_sort("said"))
    at = lambda col, i: F.coalesce(F.try_element_at(col, F.lit(i)), F.lit(""))
    fields = F.array_compact(F.array(F.when(at("gold", 1) != at("said", 1), "first"), F.when(at("gold", 2) != at("said", 2), "second")))
    return rows.select("p_partkey", F.array_join(fields, ",").alias("fields"))


@query("xtr33_alias_registry", "with r(slang, id) as (values ('ringy', 1), ('bolty', 5), ('ghost', -1)) select slang, p_name as target, p_partkey is not null as known from r left join part on p_partkey = id")
def _(c):
    r = c.frame([("ringy", 1), ("bolty", 5), ("ghost", -1)], "slang string, p_partkey long")
    return r.join(c.table("part").select("p_partkey", "p_name"), "p_partkey", "left").select("slang", F.col("p_name").alias("target"), F.col("p_name").isNotNull().alias("known"))


@query("xtr34_verdict_merge", twin("feat tok", _LIFT + ", e as (select distinct token, feature, true as listed from l where p >= 0.3) select l.token, l.feature, case when listed and lift >= 1.2 then 'keep' when listed then 'demote' when lift >= 1.5 then 'add' end as verdict from l left join e on e.token = l.token and e.feature = l.feature where listed or lift >= 1.5"))
def _(c):
    l = lift(c)  # noqa: E741
    listed = l.filter("p >= 0.3").select("token", "feature", F.lit(True).alias("listed"))
    verdict = F.when(F.col("listed") & (F.col("lift") >= 1.2), "keep").when(F.col("listed"), "demote").when(F.col("lift") >= 1.5, "add")
    return l.join(listed, ["token", "feature"], "left").select("token", "feature", verdict.alias("verdict")).filter("verdict is not null")


@query("xtr35_condition_counts", twin("feat", REQUESTS_SQL + _HAS + " select q, len(core) as conditions, count(*) filter (where list_has_all(f, core)) as hard, count(*) filter (where list_has_any(f, core)) as soft from req, has group by q, core"))
def _(c):
    rows = has(c).crossJoin(F.broadcast(requests(c)))
    n = F.size("core")
    return rows.groupBy("q", n.alias("conditions")).agg(F.count_if(F.size(F.array_intersect("f", "core")) == F.size("core")).alias("hard"), F.count_if(F.arrays_overlap("f", "core")).alias("soft"))


@query("xtr36_review_sample", "select p_type, p_partkey from (select *, row_number() over (partition by p_type order by md5(cast(p_partkey as varchar)), p_partkey) as r from part) where r <= 5")
def _(c):
    return ranking.top_n(c.table("part"), ["p_type"], [hash_key("p_partkey"), "p_partkey"], 5).select("p_type", "p_partkey")


@query("xtr37_context_threshold", "with s as (select doc_id, quality as gold, case when n_chars >= 1000 then 1 else 0 end as said from documents join labels using (doc_id)) select sum(gold * said)::bigint as tp, sum((1 - gold) * said)::bigint as fp, sum(gold * (1 - said))::bigint as fn, round(2 * sum(gold * said) / (2 * sum(gold * said) + sum((1 - gold) * said) + sum(gold * (1 - said))), 6) as f1 from s")
def _(c):
    s = c.table("documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("said")).join(c.table("labels"), "doc_id")
    as_set = lambda x: F.when(x == 1, F.array(F.lit("good"))).otherwise(F.array().cast("array<string>"))
    rows = s.select(as_set(F.col("quality")).alias("gold"), as_set(F.col("said")).alias("said"), F.lit(1).alias("one"))
    return evaluate.micro_prf(rows, "gold", "said", ["one"]).select("tp", "fp", "fn", F.round("f1", 6).alias("f1"))


#: Words that a rule reads a condition from, by condition group.
CONDITIONS = {"season": ("봄", "여름", "가을", "겨울"), "daypart": ("낮", "저녁", "새벽"), "gender": ("남자", "여자")}


def read_condition(text):
    """The first condition word that the text holds, in the order of the lexicon."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), w) for words in CONDITIONS.values() for w in words], F.lit("none"))


@query("xtr38_typo_robustness")
def _(c):
    """By condition group and kind of slip: how often the rule still reads the condition that was meant."""
    words = [(g, w) for g, ws in CONDITIONS.items() for w in ws]
    picked = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in words]), (F.col("p_partkey") % len(words) + 1).cast("int"))
    asked = c.table("part").select("p_partkey", picked(0).alias("grp"), picked(1).alias("meant"), F.concat(picked(1), F.lit("에 어울리는 향 "), "p_name").alias("said"))
    tried = [asked.select("grp", "meant", F.lit(kind).alias("kind"), tx.slipped("said", kind).alias("typed")) for kind in hangul.SLIPS]
    rows = tried[0].unionByName(tried[1]).unionByName(tried[2]).unionByName(tried[3]).withColumn("right", (read_condition(F.col("typed")) == F.col("meant")).cast("double"))
    return rows.groupBy("grp", "kind").agg(F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("accuracy"))


@query("xtr39_answer_rate", twin("feat pop", REQUESTS_SQL + _CAND + " select count(distinct req.q) as asked, count(distinct cd.q) as answered from req left join cd on cd.q = req.q"))
def _(c):
    found = searched(c).select("q").distinct().withColumn("a", F.lit(1))
    return requests(c).join(found, "q", "left").agg(F.count("*").alias("asked"), F.count("a").alias("answered"))


@query("xtr40_list_lengths", twin("feat tok", BLEND + " select q, count(*) as n from lists group by 1"))
def _(c):
    return profiles(c).ranks().select("q", "n")


@query("xtr41_retention", "select event_type, count(*) filter (where ts >= (select max(ts) from events) - interval 10 day) as kept, count(*) as n from events group by 1")
def _(c):
    last = F.broadcast(c.table("events").agg(F.max("ts").alias("last")))
    kept = F.count_if(F.col("ts") >= F.col("last") - F.expr("interval 10 days"))
    return c.table("events").crossJoin(last).groupBy("event_type").agg(kept.alias("kept"), F.count("*").alias("n"))
