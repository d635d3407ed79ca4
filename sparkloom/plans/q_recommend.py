"""Recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, recommend
from .catalogue import twin
from .q_filters import REQUESTS_SQL, requests
from .registry import query

_CAND = """, sc as (select q, item, len(core) as n_core, round(sum(strength), 4) as score, count(*) as met from req join feat on list_contains(core, feature) group by q, item, core),
cd as (select q, sc.item, n_core, score, met, people, brand from sc join pop using (item) where not exists (select 1 from feat f, req r where r.q = sc.q and f.item = sc.item and list_contains(r.avoid, f.feature)))"""
_LADDER = REQUESTS_SQL + _CAND + """, st as (select 1 as n, 'AND' as stage, * from cd where n_core >= 2 and met = n_core and people >= 330 union all select 2, 'OR', * from cd where people >= 330 union all select 3, 'OR_ANY', * from cd),
rn as (select *, row_number() over (partition by q, n order by score desc, people desc, item) as r, row_number() over (partition by q, n, brand order by score desc, people desc, item) as rb, count(*) over (partition by q, n) as total from st),
tp as (select *, row_number() over (partition by q, n order by r) as rank from rn where rb <= 2 qualify row_number() over (partition by q, n order by r) <= 5),
ch as (select q, coalesce(min(n) filter (where c >= 3), max(n)) as n from (select q, n, count(*) as c from tp group by 1, 2) group by 1),
ti as (select q, n, count(*) as candidate_count, count(*) filter (where score = cut) as tie_at_last from (select *, max(case when r = least(5, total) then score end) over (partition by q, n) as cut from rn) group by 1, 2),
ld as (select q, stage, item, rank, score, candidate_count, tie_at_last from tp join ch using (q, n) join ti using (q, n))"""


def searched(c, reqs=None):
    return recommend.ladder(recommend.candidates(requests(c) if reqs is None else reqs, c.feat, c.pop), least=330, min_results=3, k=5, cap=2)


_TEXTS = [(1, "Something with red rings"), (2, "blue, but not hot please"), (3, "nothing at all"), (4, "hot gear and a red bolt")]
_WORDS = [("red", "F red"), ("ring", "F ring"), ("blue", "F blue"), ("hot", "F hot"), ("gear", "F gear"), ("bolt", "F bolt")]


@query("rec01_understand", """with t(q, text) as (values """ + ", ".join(map(str, _TEXTS)) + "), w(surface, feature) as (values " + ", ".join(map(str, _WORDS)) + """),
m as (select q, surface, feature, contains(lower(text), 'not ' || surface) as against from t join w on contains(lower(text), surface))
select q, coalesce(string_agg(feature, '+' order by feature) filter (where not against), '') as core, coalesce(string_agg(feature, '+' order by feature) filter (where against), '') as avoid, string_agg(surface, '+' order by surface) as evidence from m group by 1""")
def _(c):
    u = recommend.understand(c.frame(_TEXTS, "q int, text string"), c.frame(_WORDS, "surface string, feature string"))
    return u.select("q", *[F.array_join(x, "+").alias(x) for x in ("core", "avoid", "evidence")])


@query("rec02_search_relaxed", twin("feat pop", _LADDER + " select * from ld"))
def _(c):
    return searched(c)


@query("rec03_single_feature_stage", twin("feat pop", REQUESTS_SQL + _CAND + " select q, item, rank from (select q, item, row_number() over (partition by q order by score desc, people desc, item) as rank from cd where met = 1) where rank <= 5"))
def _(c):
    cand = recommend.candidates(requests(c), c.feat, c.pop).filter("met = 1")
    return ranking.top_n(cand, ["q"], [F.desc("score"), F.desc("people"), "item"], 5).select("q", "item", "rank")


@query("rec04_strength_score", twin("feat pop", REQUESTS_SQL + _CAND + " select q, item, score from cd"))
def _(c):
    return recommend.candidates(requests(c), c.feat, c.pop).select("q", "item", "score")


@query("rec05_soft_avoid", twin("feat pop", REQUESTS_SQL + ", sc as (select q, item, round(sum(strength), 4) as score from req join feat on list_contains(core, feature) group by 1, 2), lo as (select q, item, sum(strength) as lost from req join feat on list_contains(avoid, feature) group by 1, 2) select q, item, round(score - 0.5::double * coalesce(lost, 0), 4) as score from sc left join lo using (q, item)"))
def _(c):
    r = requests(c)
    hard = r.select("q", "core", F.array().cast("array<string>").alias("avoid"))
    soft = c.feat.join(F.broadcast(r.select("q", F.explode("avoid").alias("feature"))), "feature")
    return recommend.softened(recommend.candidates(hard, c.feat, c.pop), soft, F.col("strength"), 0.5).select("q", "item", "score")


@query("rec06_response", twin("feat pop", _LADDER + ", n as (select q, max(stage) as stage, count(*) as n_results from ld group by 1) select req.q, case when len(core) = 0 then 'NO_CONDITION' when n.q is null then 'NO_RESULT' else 'OK' end as status, stage, coalesce(n_results, 0) as n_results from req left join n on n.q = req.q"))
def _(c):
    r = recommend.response(searched(c), requests(c), c.feat)
    return r.select("q", "status", "stage", F.coalesce(F.json_array_length("results"), F.lit(0)).cast("long").alias("n_results"))


@query("rec07_category_score", twin("votes pop", "select item, round(((case when q1 + q2 > 0 then q1 / (q1 + q2) else 0 end) + (case when day + night >= 600 then day / (day + night) else 0 end)) / 2, 6) as score from votes"))
def _(c):
    season = F.when(F.col("q1") + F.col("q2") > 0, F.col("q1") / (F.col("q1") + F.col("q2")))
    part = F.when(F.col("day") + F.col("night") >= 600, F.col("day") / (F.col("day") + F.col("night")))
    return c.votes.select("item", F.round(recommend.category_score([season, part]), 6).alias("score"))


@query("rec08_explanation", twin("feat pop", REQUESTS_SQL + " select q, item, string_agg(feature, ', ' order by feature) as why, count(*) = len(core) as satisfied from req join feat on list_contains(core, feature) group by q, item, core"))
def _(c):
    wanted = F.broadcast(requests(c).select("q", F.explode("core").alias("feature"), F.size("core").alias("n")))
    return c.feat.join(wanted, "feature").groupBy("q", "item", "n").agg(F.concat_ws(", ", F.array_sort(F.collect_list("feature"))).alias("why"), F.count("*").alias("k")).select("q", "item", "why", (F.col("k") == F.col("n")).alias("satisfied"))


@query("rec09_alias_max", twin("feat", "select item, split_part(feature, ' ', 1) as concept, max(strength) as strength from feat group by 1, 2"))
def _(c):
    return c.feat.groupBy("item", F.split_part("feature", F.lit(" "), F.lit(1)).alias("concept")).agg(F.max("strength").alias("strength"))


@query("rec10_stage_ablation", twin("feat pop", REQUESTS_SQL + _CAND + ", g(least) as (values (0), (330), (340)) select least, mode, count(distinct q) as answered, count(*) as n from (select least, 'AND' as mode, q from cd, g where people >= least and met = n_core union all select least, 'OR', q from cd, g where people >= least) group by 1, 2"))
def _(c):
    grid = F.broadcast(c.frame([(t, m) for t in (0, 330, 340) for m in ("AND", "OR")], "least int, mode string"))
    cand = recommend.candidates(requests(c), c.feat, c.pop)
    rows = cand.join(grid, (F.col("people") >= F.col("least")) & ((F.col("mode") == "OR") | (F.col("met") == F.col("n_core"))))
    return rows.groupBy("least", "mode").agg(F.count_distinct("q").alias("answered"), F.count("*").alias("n"))


@query("rec11_bonus_modes", twin("feat pop", REQUESTS_SQL + _CAND + ", m as (select 'plain' as mode, q, item, score as s from cd union all select 'bonus', q, item, score + 10 * met from cd) select mode, q, item, rank from (select *, row_number() over (partition by mode, q order by s desc, item) as rank from m) where rank <= 5"))
def _(c):
    cand = recommend.candidates(requests(c), c.feat, c.pop)
    modes = F.explode(F.array(F.struct(F.lit("plain").alias("mode"), F.col("score").alias("s")), F.struct(F.lit("bonus").alias("mode"), (F.col("score") + 10 * F.col("met")).alias("s"))))
    rows = cand.select("q", "item", modes.alias("m")).select("q", "item", "m.*")
    return ranking.top_n(rows, ["mode", "q"], [F.desc("s"), "item"], 5).select("mode", "q", "item", "rank")
