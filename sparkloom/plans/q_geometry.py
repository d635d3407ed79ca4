"""Sampling and geometry: quotas, layouts, territories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, ranking, sampling
from ..operators.geometry import points
from .catalogue import twin
from .q_aggregates import _FAMILY, family_score
from .registry import query

_PT = "pt as (select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, label from embeddings)"
_D2 = ", dl as (select a.id as a, b.id as b, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 10) as d from pt a join pt b on a.id <> b.id)"
_D64 = ", ds as (select a.vec_id as a, b.vec_id as b, round(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 8) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id)"
_RANKS = ", rs as (select a, b, row_number() over (partition by a order by d, b) as rs from ds), rl as (select a, b, row_number() over (partition by a order by d, b) as rl from dl)"


def source(c):
    return geometry.vector_distances(c.table("embeddings"), "vec_id", "embedding")


def layout(c):
    return geometry.distances(points(c))


@query("smp01_root_quota")
def _(c):
    quota = sampling.root_quota(sampling.group_supply(c.table("part"), "p_type"), 100)
    return c.frame(sorted(quota.items()), "p_type string, quota int")


@query("smp02_quota_selection")
def _(c):
    part = c.table("part")
    return sampling.select_by_quota(part, "p_type", [F.desc("p_retailprice"), "p_partkey"], sampling.root_quota(sampling.group_supply(part, "p_type"), 120, floor=5, cap=40)).select("p_type", "p_partkey")


@query("smp03_water_level", "select p_type, p_partkey from (select *, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as r from part) where r <= 20")
def _(c):
    # 120 places over six types that all have more than 20 rows: the level is 20.
    part = c.table("part")
    return sampling.select_by_quota(part, "p_type", [F.desc("p_retailprice"), "p_partkey"], sampling.water_level_quota(sampling.group_supply(part, "p_type"), 120, cap=30)).select("p_type", "p_partkey")


@query("smp04_round_robin", "select p_partkey, cast((row_number() over (partition by p_type order by md5(cast(p_partkey as varchar)), p_partkey) - 1) % 7 as integer) as batch from part")
def _(c):
    return sampling.round_robin(c.table("part"), ["p_type"], "p_partkey", 7).select("p_partkey", "batch")


@query("smp05_hash_split", "select part, count(*) as n from (select case when b < 70 then 'train' when b < 85 then 'dev' else 'test' end as part from (select cast(('0x' || substr(md5(cast(p_partkey as varchar) || '/3'), 1, 6)) as bigint) % 100 as b from part)) group by 1")
def _(c):
    return c.table("part").select(sampling.hash_split("p_partkey", {"train": 70, "dev": 15, "test": 15}, seed=3).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("geo01_pca")
def _(c):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = c.table("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", F.round(F.abs(F.col("p")[0]), 6).alias("x"), F.round(F.abs(F.col("p")[1]), 6).alias("y"))


@query("geo02_radviz", twin("feat", _FAMILY + ", an as (select family, row_number() over (order by family) - 1 as i, count(*) over () as n from (select distinct family from sc)) select item, round(sum(score * cos(2 * pi() * i / n)), 6) as x, round(sum(score * sin(2 * pi() * i / n)), 6) as y from sc join an using (family) group by 1"))
def _(c):
    s = family_score(c)
    names = F.broadcast(s.agg(F.array_sort(F.collect_set("family")).alias("names")))  # a handful of families
    angle = 2 * F.pi() * (F.array_position("names", F.col("family")) - 1) / F.size("names")
    return s.crossJoin(names).groupBy("item").agg(F.round(F.sum(F.col("score") * F.cos(angle)), 6).alias("x"), F.round(F.sum(F.col("score") * F.sin(angle)), 6).alias("y"))


@query("geo03_trust_continuity", "with " + _PT + _D2 + _D64 + _RANKS + ", n as (select count(*)::double as n from pt) select round(1 - 2.0 / (n * 10 * (2 * n - 31)) * (select sum(case when rl <= 10 and rs > 10 then rs - 10 else 0 end) from rs join rl using (a, b)), 6) as trustworthiness, round(1 - 2.0 / (n * 10 * (2 * n - 31)) * (select sum(case when rs <= 10 and rl > 10 then rl - 10 else 0 end) from rs join rl using (a, b)), 6) as continuity from n")
def _(c):
    return geometry.trust_continuity(source(c), layout(c), 10).select(F.round("trustworthiness", 6).alias("trustworthiness"), F.round("continuity", 6).alias("continuity"))


@query("geo04_knn_overlap", "with " + _PT + _D2 + _D64 + _RANKS + " select round(count(*) / (10.0 * (select count(*) from pt)), 6) as overlap from rs join rl using (a, b) where rs <= 10 and rl <= 10")
def _(c):
    return geometry.knn_overlap(source(c), layout(c), 10).select(F.round("overlap", 6).alias("overlap"))


@query("geo05_distance_rank", "with " + _PT + _D2 + _D64 + ", p as (select ds.d as x, dl.d as y from ds join dl using (a, b) where a < b), r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as x, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as y from p) select round(corr(x, y), 6) as rho from r")
def _(c):
    return geometry.distance_rank_correlation(source(c), layout(c)).select(F.round("rho", 6).alias("rho"))


@query("geo06_cohesion", "with " + _PT + _D2 + ", k as (select a, b from (select a, b, row_number() over (partition by a order by d, b) as r from dl) where r <= 10) select round((select avg(case when x.label = y.label then 1.0 else 0 end) from k join pt x on x.id = a join pt y on y.id = b), 6) as observed, round((select sum(s * s) from (select count(*) / (select count(*)::double from pt) as s from pt group by label)), 6) as expected")
def _(c):
    return geometry.cohesion(geometry.Points(points(c)).knn(10), points(c)).select(F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"))


@query("geo07_agglomerative")
def _(c):
    return geometry.agglomerative_by_label(points(c), 5).select("id", "cluster")


@query("geo08_silhouette", "with " + _PT + _D2 + ", m as (select a, x.label as la, y.label as lb, avg(d) as m from dl join pt x on x.id = a join pt y on y.id = b group by 1, 2, 3), s as (select a as id, max(m) filter (where la = lb) as i, min(m) filter (where la <> lb) as o from m group by 1) select id, round((o - i) / greatest(o, i), 6) as s from s")
def _(c):
    return geometry.silhouette(geometry.Points(points(c)).label_sums()).select("id", F.round("s", 6).alias("s"))


@query("geo09_merge_small", "with " + _PT + _D2 + ", lg as (select label from pt group by 1 having count(*) >= 50), nr as (select dl.a as id, t.label, row_number() over (partition by dl.a order by round(avg(d), 10), t.label) as r from dl join pt m on m.id = dl.a join pt t on t.id = dl.b where m.label not in (select label from lg) and t.label in (select label from lg) group by 1, 2) select id, label from pt where label in (select label from lg) union all select id, label from nr where r = 1")
def _(c):
    return geometry.merge_small(layout(c), points(c), 50)


@query("geo10_kmeans")
def _(c):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = c.table("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=10, seed=42).fit(v).transform(v).select("vec_id", F.col("prediction").alias("cluster"))


@query("geo11_unit_scale", "with " + _PT + ", b as (select min(x) as x0, min(y) as y0, greatest(max(x) - min(x), max(y) - min(y)) as w from pt) select id, round((x - x0) / w, 6) as x, round((y - y0) / w, 6) as y from pt, b")
def _(c):
    return geometry.unit_scaled(points(c)).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("geo12_procrustes", "with p as (select cast(embedding[1] as double) as ax, cast(embedding[2] as double) as ay, cast(embedding[3] as double) as bx, cast(embedding[4] as double) as by_ from embeddings), m as (select covar_pop(bx, ax) + covar_pop(by_, ay) as s, covar_pop(bx, ay) - covar_pop(by_, ax) as t, var_pop(ax) + var_pop(ay) as va, var_pop(bx) + var_pop(by_) as vb from p) select round(atan2(t, s), 6) as angle, round(sqrt(s * s + t * t) / vb, 6) as scale, round(1 - (s * s + t * t) / (va * vb), 6) as residual from m")
def _(c):
    e = F.col("embedding")
    b = c.table("embeddings").select(F.col("vec_id").alias("id"), e[2].cast("double").alias("x"), e[3].cast("double").alias("y"))
    return geometry.procrustes(points(c), b).select(*[F.round(x, 6).alias(x) for x in ("angle", "scale", "residual")])


@query("geo13_rotation_search", "with " + _PT + ", tn as (select degree, round(x * sin(radians(degree)) + y * cos(radians(degree)), 10) as t, label from pt, (select unnest(generate_series(0, 179))::integer as degree)), r as (select degree, rank() over (partition by degree order by t) + (count(*) over (partition by degree, t) - 1) / 2 as x, rank() over (partition by degree order by label) + (count(*) over (partition by degree, label) - 1) / 2 as y from tn) select degree, round(abs(corr(x, y)), 6) as rho from r group by 1")
def _(c):
    return geometry.rotation_search(points(c), "label").select("degree", F.round("rho", 6).alias("rho"))


_UNIT = ", bx as (select min(x) as x0, min(y) as y0, greatest(max(x) - min(x), max(y) - min(y)) as w from pt), un as (select id, label, (x - x0) / w as x, (y - y0) / w as y from pt, bx)"
_GRID = ", gr as (select r::integer as row, c::integer as col, (c + 0.5::double) / 12 as gx, (r + 0.5::double) / 12 as gy from (select unnest(generate_series(0, 11)) as r), (select unnest(generate_series(0, 11)) as c))"


def _kde_sql(by, name):
    g = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    join = f"join mo using ({by})" if by else "cross join mo"
    return f""", mo as (select {g}count(*)::double as n, covar_samp(x, x) * pow(count(*), -1.0 / 3) as sxx, covar_samp(y, y) * pow(count(*), -1.0 / 3) as syy, covar_samp(x, y) * pow(count(*), -1.0 / 3) as sxy from un {group}),
{name} as (select {g}row, col, sum(exp(-0.5 * (syy * (gx - x) ** 2 - 2 * sxy * (gx - x) * (gy - y) + sxx * (gy - y) ** 2) / (sxx * syy - sxy * sxy)) / (n * 2 * pi() * sqrt(sxx * syy - sxy * sxy))) as density from un {join} cross join gr group by {g}row, col)"""


def density(c, by=()):
    return geometry.kde(geometry.unit_scaled(points(c)), geometry.grid(c.table("embeddings"), 12), list(by))


@query("geo14_kde_grid", "with " + _PT + _UNIT + _GRID + _kde_sql("", "kd") + " select row, col, round(density, 6) as density from kd")
def _(c):
    return density(c).select("row", "col", F.round("density", 6).alias("density"))


@query("geo15_blur", "with " + _PT + _UNIT + ", h as (select least(11, greatest(0, floor(y * 12)::integer)) as r, least(11, greatest(0, floor(x * 12)::integer)) as c, count(*) as n from un group by 1, 2), ke as (select i::integer as i, j::integer as j, exp(-0.5 * (i * i + j * j)) as k from (select unnest(generate_series(-2, 2)) as i), (select unnest(generate_series(-2, 2)) as j)) select r + i as row, c + j as col, round(sum(n * k) / (select sum(k) from ke), 6) as v from h, ke where r + i between 0 and 11 and c + j between 0 and 11 group by 1, 2")
def _(c):
    return geometry.blurred_histogram(geometry.unit_scaled(points(c)), 12).select("row", "col", F.round("v", 6).alias("v"))


@query("geo16_quantise", "with " + _PT + _UNIT + _GRID + _kde_sql("", "kd") + " select row, col, round_even(255 * density / (select max(density) from kd), 0)::integer as level, density > (select quantile_cont(density, 0.4) from kd) as land from kd")
def _(c):
    return geometry.quantised(density(c), 0.4)


@query("geo17_territories", "with " + _PT + _UNIT + _GRID + _kde_sql("label", "kd") + ", t as (select row, col, label from (select *, row_number() over (partition by row, col order by round(density, 9) desc, label) as r from kd) where r = 1) select label, count(*) as area, round(count(*) / 144.0, 6) as coverage, max(row) - min(row) as height from t group by 1")
def _(c):
    d = density(c, ["label"]).withColumn("density", F.round("density", 9))
    t = ranking.first_by(d, ["row", "col"], [F.desc("density"), "label"])
    return t.groupBy("label").agg(F.count("*").alias("area"), F.round(F.count("*") / 144.0, 6).alias("coverage"), (F.max("row") - F.min("row")).alias("height"))


@query("geo18_grid_components", "with recursive " + _PT + _UNIT + _GRID + _kde_sql("", "kd") + ", la as (select row, col, row * 12 + col as id from kd where density > (select quantile_cont(density, 0.6) from kd)), re as (select id as a, id as b, row, col from la union select re.a, la.id, la.row, la.col from re join la on abs(la.row - re.row) + abs(la.col - re.col) = 1), co as (select a, min(b) as m from re group by 1) select row, col, dense_rank() over (order by m)::integer as component from la join co on co.a = la.id")
def _(c):
    return geometry.grid_components(geometry.quantised(density(c), 0.6).filter("land"))


@query("geo19_contour")
def _(c):
    return geometry.contour_segments(density(c), 0.5)


@query("geo20_cell_index", "with " + _PT + _UNIT + " select id, least(11, greatest(0, floor(y * 12)::integer)) as row, least(11, greatest(0, floor(x * 12)::integer)) as col from un")
def _(c):
    return geometry.unit_scaled(points(c)).select("id", geometry.cell_of(F.col("y"), 12).alias("row"), geometry.cell_of(F.col("x"), 12).alias("col"))


@query("geo21_soft_membership", twin("feat", _FAMILY + " select item, family, score as weight, rank from (select *, row_number() over (partition by item order by score desc, family) as rank from sc) where rank = 1 or score >= 0.2"))
def _(c):
    return geometry.soft_membership(family_score(c), 0.2)


@query("geo22_transition_zone", "with " + _PT + ", ce as (select label, avg(x) as cx, avg(y) as cy from pt group by 1), dd as (select id, pt.label, sqrt((x - cx) ** 2 + (y - cy) ** 2) as d, pt.label = ce.label as own from pt, ce), r as (select id, max(d) filter (where own) as mine, min(d) filter (where not own) as other from dd group by 1) select id, round(mine / other, 6) as ratio, mine / other > 0.8 and mine / other < 1.25 as zone from r")
def _(c):
    p = points(c)
    centres = F.broadcast(p.groupBy(F.col("label").alias("cl")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    r = p.crossJoin(centres).withColumn("d", d).groupBy("id").agg(F.max(F.when(F.col("label") == F.col("cl"), F.col("d"))).alias("mine"), F.min(F.when(F.col("label") != F.col("cl"), F.col("d"))).alias("other"))
    ratio = F.col("mine") / F.col("other")
    return r.select("id", F.round(ratio, 6).alias("ratio"), ((ratio > 0.8) & (ratio < 1.25)).alias("zone"))
