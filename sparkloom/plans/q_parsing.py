"""Parsing and shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from .catalogue import twin
from .registry import query

_CELL = "p_brand || ':' || p_size || '|' || replace(p_name, ' ', ':') || ':' || (p_partkey % 97) || '|' || p_type || ':x|'"


def cells(c):
    cell = F.concat("p_brand", F.lit(":"), "p_size", F.lit("|"), F.replace("p_name", F.lit(" "), F.lit(":")), F.lit(":"), F.col("p_partkey") % 97, F.lit("|"), "p_type", F.lit(":x|"))
    return c.table("part").select("p_partkey", "p_brand", "p_size", cell.alias("cell"))


@query("prs01_weighted_list", "select p_partkey, p_brand as name, p_size::double as strength from part union all select p_partkey, replace(p_name, ' ', ':'), (p_partkey % 97)::double from part")
def _(c):
    return cells(c).select("p_partkey", F.explode(parsing.weighted_list("cell")).alias("x")).select("p_partkey", "x.*")


@query("prs02_sorted_list", "select p_partkey, case when p_size > p_partkey % 97 or (p_size = p_partkey % 97 and p_brand < replace(p_name, ' ', ':')) then p_brand else replace(p_name, ' ', ':') end as strongest from part")
def _(c):
    return cells(c).select("p_partkey", parsing.by_strength(parsing.weighted_list("cell"))[0]["name"].alias("strongest"))


@query("prs03_repaired_split", "select p_partkey, case when p_name = 'red widget' then 1 else 2 end as n from part")
def _(c):
    cut = c.table("part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("|")).alias("cell"))
    return cut.select("p_partkey", F.size(parsing.repaired_split("cell", ["red|widget"])).alias("n"))


@query("prs04_column_union", "select p_partkey, len(list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type), split_part(p_name, ' ', 1)]))) as n from part")
def _(c):
    p = c.table("part").select("p_partkey", F.split("p_name", " ").alias("a"), F.array(F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("b"), F.lit(None).cast("array<string>").alias("d"))
    return p.select("p_partkey", F.size(parsing.union_of("a", "b", "d")).alias("n"))


@query("prs05_tier_token", "select p_partkey, case when i = 1 then 'top' else 'base' end || '::' || w as token from (select p_partkey, unnest(string_split(p_name, ' ')) as w, unnest([1, 2]) as i from part)")
def _(c):
    w = c.table("part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    return w.select("p_partkey", F.concat(F.when(F.col("i") == 0, "top").otherwise("base"), F.lit("::"), "w").alias("token"))


@query("prs06_dominant", twin("feat", "select item, arg_max(feature, strength * 1000 - length(feature) / 1000.0) as dominant from feat where strength = 100 group by 1 having count(*) = 1"))
def _(c):
    top = c.feat.filter("strength = 100").groupBy("item").agg(F.collect_list("feature").alias("f")).filter(F.size("f") == 1)
    return top.select("item", F.try_element_at("f", F.lit(1)).alias("dominant"))


@query("prs07_regex_extract", "select p_partkey, cast(regexp_extract(p_brand, '#([0-9]+)$', 1) as int) as brand_no from part")
def _(c):
    return c.table("part").select("p_partkey", F.regexp_extract("p_brand", "#([0-9]+)$", 1).cast("int").alias("brand_no"))


@query("prs08_mapped_category", "select p_partkey, case split_part(p_name, ' ', 1) when 'red' then 'warm' when 'hot' then 'warm' when 'blue' then 'cool' end as grp from part")
def _(c):
    words = F.create_map(*[F.lit(x) for kv in {"red": "warm", "hot": "warm", "blue": "cool"}.items() for x in kv])
    return c.table("part").select("p_partkey", F.try_element_at(words, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("grp"))


@query("prs09_vocabulary_index", twin("feat", ", v as (select feature, dense_rank() over (order by feature) - 1 as col from (select distinct feature from feat)) select item, col, strength from feat join v using (feature)"))
def _(c):
    names = c.feat.agg(F.array_sort(F.collect_set("feature")).alias("names"))  # brands by types: a vocabulary of fixed size
    index = names.select(F.posexplode("names").alias("col", "feature"))
    return c.feat.join(index, "feature").select("item", F.col("col").cast("long").alias("col"), "strength")


@query("prs10_merged_tiers", "with w as (select p_brand, p_partkey, unnest(string_split(p_name, ' ')) as note, unnest(['top', 'base']) as tier, unnest([1, 2]) as pos from part) select p_brand, note, min(p_partkey * 10 + pos) as first_pos, array_to_string(list_sort(list(distinct tier)), '+') as tiers from w group by 1, 2")
def _(c):
    w = c.table("part").select("p_brand", "p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "note"))
    tier = F.when(F.col("i") == 0, "top").otherwise("base")
    return w.groupBy("p_brand", "note").agg(F.min(F.col("p_partkey") * 10 + F.col("i") + 1).alias("first_pos"), F.array_join(F.array_sort(F.collect_set(tier)), "+").alias("tiers"))


@query("prs11_fenced_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(c):
    reply = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\n"))
    return c.table("events").select("event_id", parsing.fenced_json(reply, "k long")["k"].alias("k"))


@query("prs12_schema_validation", "select event_id, array_to_string(list_filter([case when event_type not in ('view', 'click') then 'ENUM' end, case when cast(json_extract_string(props, '$.k') as bigint) > 50 then 'RANGE' end], lambda x: x is not null), ',') as issues from events")
def _(c):
    r = F.from_json("props", "k long, missing array<string>")
    codes = F.array(F.when(~F.col("event_type").isin("view", "click"), "ENUM"), F.when(r["k"] > 50, "RANGE"))
    return c.table("events").select("event_id", F.array_join(F.array_compact(codes), ",").alias("issues"))


@query("prs13_structure_profile", "select * from (values ('props.k', 'bigint'), ('tags[]', 'string'), ('user_id', 'bigint')) v(path, type)")
def _(c):
    nested = c.table("events").select("user_id", F.from_json("props", "k long").alias("props"), F.array("event_type").alias("tags"))
    return c.frame(parsing.profile(nested.schema), "path string, type string")


@query("prs14_url_parse", "select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page from pages")
def _(c):
    u = c.table("pages")
    return u.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"))


@query("prs15_melt", twin("votes", "select item, unnest(['q1', 'q2', 'q3', 'q4']) as season, unnest([q1, q2, q3, q4]) as n from votes"))
def _(c):
    return c.votes.unpivot("item", ["q1", "q2", "q3", "q4"], "season", "n")
