"""Text, lexicon and query understanding. Texts are part names, and titles made from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hangul
from ..functions import text as tx
from ..functions import titles as titles_of
from ..operators import ranking
from .catalogue import twin
from .q_joins import _LIFT, lift
from .registry import query

_TITLE = "'[SALE] ' || p_brand || ' ' || p_name || case p_size % 4 when 0 then ' Eau de Parfum 30/50ml' when 1 then ' EDT 100 ml' when 2 then ' (mini) 7.5ml + pouch' else ' extrait de parfum EDP' end"
_T = f"with t as (select p_partkey, p_brand, p_size, {_TITLE} as title from part)"


def titles(c):
    tail = F.element_at(F.array(F.lit(" Eau de Parfum 30/50ml"), F.lit(" EDT 100 ml"), F.lit(" (mini) 7.5ml + pouch"), F.lit(" extrait de parfum EDP")), F.col("p_size") % 4 + 1)
    return c.table("part").select("p_partkey", "p_brand", "p_size", F.concat(F.lit("[SALE] "), "p_brand", F.lit(" "), "p_name", tail).alias("title"))


_LEX = [("red ring", "red|ring", "warm", ""), ("blue", "navy", "cool", "ring,bolt"), ("hot", "", "warm", ""), ("small gizmo", "", "light", ""), ("gear", "", "heavy", "hot")]
_LEX_SQL = ", lx(expression, aliases, feature, cond) as (values " + ", ".join(str(x) for x in _LEX) + "), sf as (select distinct expression, feature, cond, unnest(list_filter(list_concat([expression], string_split(aliases, '|')), lambda x: x <> '')) as surface from lx)"


def lexicon(c):
    from ..sources.readers import lexicon as surfaces

    rows = c.frame(_LEX, "expression string, aliases string, feature string, cond string")
    return surfaces(rows).join(rows.drop("aliases"), "expression")


def hits(c):
    """Part names with the lexicon entries that a surface of theirs calls for."""
    lex = F.broadcast(lexicon(c))
    return c.table("part").join(lex, F.col("p_name").contains(F.col("surface")) & F.exists(F.split("cond", ","), lambda t: (t == "") | F.contains("p_name", t))).select("p_partkey", "p_name", "expression", "feature").distinct()


_HITS = _LEX_SQL + ", ht as (select distinct p_partkey, p_name, expression, feature from part join sf on contains(p_name, surface) where cond = '' or len(list_filter(string_split(cond, ','), lambda t: contains(p_name, t))) > 0)"


@query("txt01_folded", "select p_partkey, lower(p_brand) || ' ' || p_name as folded from part")
def _(c):
    return c.table("part").select("p_partkey", tx.folded(F.concat(F.lit("  "), F.upper("p_brand"), F.lit(" \t "), "p_name")).alias("folded"))


@query("txt02_latin_key", "select p_partkey, regexp_replace(strip_accents(lower(p_brand || 'é' || p_name)), '[^a-z0-9]', '', 'g') as key from part")
def _(c):
    return c.table("part").select("p_partkey", tx.latin_key(F.concat("p_brand", F.lit("é"), "p_name")).alias("key"))


@query("txt03_alnum_key", "select p_partkey, regexp_replace(lower(p_brand || p_name), '[^a-z0-9]', '', 'g') as key from part")
def _(c):
    return c.table("part").select("p_partkey", tx.alnum_key(F.concat("p_brand", "p_name")).alias("key"))


@query("txt04_compact_key", "select p_partkey, regexp_replace(lower(p_brand || ' 향 ' || p_name), '[^0-9a-z가-힣]', '', 'g') as key from part")
def _(c):
    return c.table("part").select("p_partkey", tx.compact_key(F.concat("p_brand", F.lit(" 향 "), "p_name")).alias("key"))


def _spelled(n: str) -> str:
    """SQL for the Latin spelling of syllable number n."""
    table = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
    return f"{table(hangul.INITIALS)}[{n} // 588 + 1] || {table(hangul.MEDIALS)}[{n} % 588 // 28 + 1] || {table(hangul.FINALS)}[{n} % 28 + 1]"


def syllables(c):
    """Two syllables per part, spread over all 11,172, before the part's name."""
    two = F.concat(*[F.decode(F.unhex(F.lpad(F.hex(44032 + (F.col("p_partkey") * m) % 11172), 4, "0")), "UTF-16BE") for m in (1237, 7919)])
    return c.table("part").select("p_partkey", "p_type", F.concat(two, F.lit(" "), "p_name").alias("said"))


_SPELLED = f"with s as (select p_partkey, p_name, p_partkey * 1237 % 11172 as a, p_partkey * 7919 % 11172 as b from part), r as (select p_partkey, {_spelled('a')} || {_spelled('b')} || ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as roman from s)"
_SOUND = "roman"
for _a, _b in hangul.SOUNDS:
    _SOUND = f"replace({_SOUND}, '{_a}', '{_b}')"


@query("txt05_romanised", _SPELLED + " select p_partkey, roman from r")
def _(c):
    return syllables(c).select("p_partkey", tx.romanised("said").alias("roman"))


@query("txt06_phonetic_key", _SPELLED + f", k as (select p_partkey, regexp_replace({_SOUND}, '[^a-z0-9]|[aeiou]', '', 'g') as k from r) select p_partkey, list_reduce(list_prepend('', string_split(k, '')), lambda x, y: case when right(x, 1) = y then x else x || y end) as key from k")
def _(c):
    return syllables(c).select("p_partkey", tx.phonetic_key("said").alias("key"))


@query("txt07_jamo", "select p_partkey, sum(case when n % 28 = 0 then 2 else 3 end)::integer + 1 + length(any_value(p_name)) as letters from (select p_partkey, p_name, unnest([p_partkey * 1237 % 11172, p_partkey * 7919 % 11172]) as n from part) group by 1")
def _(c):
    return syllables(c).select("p_partkey", F.char_length(tx.jamo("said")).alias("letters"))


_NAMES = "with v as (select distinct p_name as w from part)"


@query("txt08_bounded_levenshtein", _NAMES + " select a.w as a, b.w as b, least(levenshtein(a.w, b.w), 4)::integer as d from v a, v b where a.w < b.w")
def _(c):
    v = c.table("part").select(F.col("p_name").alias("a")).distinct()
    return v.join(F.broadcast(v.withColumnRenamed("a", "b")), F.col("a") < F.col("b")).select("a", "b", tx.bounded_levenshtein("a", "b", 3).alias("d"))


@query("txt09_typo_protection", _NAMES + ", x as (select distinct unnest(string_split(w, ' ')) as w from v), y as (select w || 's' as w from x union select w from x) select a.w as word, count(*) as near from y a join y b on a.w <> b.w and abs(length(a.w) - length(b.w)) <= 1 and levenshtein(a.w, b.w) = 1 group by 1")
def _(c):
    w = c.table("part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    y = w.unionByName(w.select(F.concat("w", F.lit("s")).alias("w"))).distinct().withColumn("len", F.char_length("w"))
    # Blocked on length: a word meets lengths one off only.
    near = y.select(F.col("w").alias("v"), F.explode(F.array(F.col("len") - 1, F.col("len"), F.col("len") + 1)).alias("len"))
    met = y.join(near, "len").filter((F.col("w") != F.col("v")) & (tx.bounded_levenshtein("w", "v", 1) == 1))
    return met.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("near"))


@query("txt10_ratio")
def _(c):
    v = c.table("part").select(F.col("p_name").alias("a")).distinct()
    return v.join(F.broadcast(v.withColumnRenamed("a", "b")), F.col("a") < F.col("b")).select("a", "b", F.round(tx.ratio("a", "b"), 6).alias("ratio"))


@query("txt11_containment", _NAMES + ", x as (select distinct unnest(string_split(w, ' ')) as t from v) select w, t, round(case when contains(w, t) then length(t) / length(w) else 0 end, 6) as share from v, x")
def _(c):
    v = c.table("part").select(F.col("p_name").alias("w")).distinct()
    x = v.select(F.explode(F.split("w", " ")).alias("t")).distinct()
    return v.crossJoin(F.broadcast(x)).select("w", "t", F.round(tx.containment(F.col("w"), F.col("t")), 6).alias("share"))


@query("txt12_surface_lookup", "with z as (select 1)" + _LEX_SQL + " select p_partkey, expression from part join sf on contains(p_name, surface) group by 1, 2")
def _(c):
    return c.table("part").join(F.broadcast(lexicon(c)), F.col("p_name").contains(F.col("surface"))).select("p_partkey", "expression").distinct()


@query("txt13_conditional_match", "with z as (select 1)" + _HITS + " select p_partkey, expression from ht")
def _(c):
    return hits(c).select("p_partkey", "expression")


_WORDS = ["red ring", "red", "ring", "blue bolt", "bolt", "gear"]


@query("txt14_longest_spans", "select p_partkey, case when p_name in ('red ring', 'blue bolt') then p_name else array_to_string(list_filter(string_split(p_name, ' '), lambda w: w in ('red', 'ring', 'bolt', 'gear')), '+') end as spans from part")
def _(c):
    return c.table("part").select("p_partkey", F.array_join(F.transform(tx.spans("p_name", _WORDS), lambda s: s["surface"]), "+").alias("spans"))


@query("txt15_ambiguity", "select p_partkey, case when p_size % 2 = 0 then 'note' when p_brand like '%1' then 'feature' else 'word' end as choice from part")
def _(c):
    said = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " note").otherwise(""))
    rule = F.when(said.rlike("(?: note|노트|향)$"), "note").when(F.col("p_brand").endswith("1"), "feature").otherwise("word")
    return c.table("part").select("p_partkey", rule.alias("choice"))


@query("txt16_consuming_match", "select p_partkey, case when contains(p_name, 'small gizmo') then 1 when contains(p_name, 'small') or contains(p_name, 'gizmo') then 1 else 0 end as n from part")
def _(c):
    return c.table("part").select("p_partkey", F.size(tx.spans("p_name", ["small gizmo", "small", "gizmo"])).alias("n"))


@query("txt17_particle_boundary", "select n_nationkey, n_nationkey % 3 <> 2 as hit from nation")
def _(c):
    said = F.element_at(F.array(F.lit("장미를 좋아해"), F.lit("장미!"), F.lit("장미빛")), F.col("n_nationkey") % 3 + 1)
    return c.table("nation").select("n_nationkey", said.rlike(tx.particle_bounded("장미", ["를", "은", "이"])).alias("hit"))


_LADDER = """with w as (select distinct unnest(string_split(p_name, ' ')) as w from part), known as (select w as known from w union select w || 'y' from w union select p_name from part),
a as (select p_partkey, case p_size % 6 when 0 then p_name when 1 then '  ' || upper(replace(p_name, ' ', '   ')) || ' ' when 2 then replace(p_name, ' ', 's ') || 's' when 3 then split_part(p_name, ' ', 1) || 'es'
  when 4 then initcap_(split_part(p_name, ' ', 2)) else 'no such ' || p_name end as said from part),
b as (select *, trim(regexp_replace(lower(trim(said)), '\\s+', ' ', 'g')) as low from a), c as (select *, trim(regexp_replace(low, 's\\b', '', 'g')) as one from b),
f as (select p_partkey, unnest([said, low, one, regexp_replace(one, 'e$', '') || 'y', one || 'y']) as form, unnest([1, 2, 3, 4, 5]) as step from c)
select p_partkey, arg_min(form, step) as found from f where form in (select known from known) group by 1"""


@query("txt18_name_ladder", _LADDER.replace("initcap_(split_part(p_name, ' ', 2))", "upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2)"))
def _(c):
    word = c.table("part").select(F.explode(F.split("p_name", " ")).alias("known"))
    known = word.unionByName(word.select(F.concat("known", F.lit("y")).alias("known"))).unionByName(c.table("part").select(F.col("p_name").alias("known"))).distinct()
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    kinds = (F.col("p_name"), F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit("   "))), F.lit(" ")), F.concat(F.replace("p_name", F.lit(" "), F.lit("s ")), F.lit("s")), F.concat(first, F.lit("es")), F.initcap(second))
    said = F.concat(F.lit("no such "), "p_name")
    for i, kind in enumerate(kinds):
        said = F.when(F.col("p_size") % 6 == i, kind).otherwise(said)
    forms = c.table("part").select("p_partkey", F.posexplode(tx.singulars(said)).alias("step", "known"))
    return ranking.first_by(forms.join(known, "known"), ["p_partkey"], ["step"]).select("p_partkey", F.col("known").alias("found"))


@query("txt19_negation_scope", "select p_partkey, case when p_size % 2 = 0 then split_part(p_name, ' ', 1) else '' end as negated from part where split_part(p_name, ' ', 1) in ('red', 'blue', 'hot')")
def _(c):
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("please not "), "p_name")).otherwise(F.col("p_name"))
    rows = c.table("part").filter(F.split_part("p_name", F.lit(" "), F.lit(1)).isin("red", "blue", "hot"))
    return rows.select("p_partkey", F.array_join(tx.negated_spans(said, ["red", "blue", "hot"], ["not "], 5, 3), "+").alias("negated"))


@query("txt20_last_rule", "select p_partkey, case when p_size % 2 = 0 then 'LOW' when p_size % 3 = 0 then 'HIGH' end as intensity from part")
def _(c):
    said = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " strong").otherwise(""), F.when(F.col("p_size") % 2 == 0, " soft").otherwise(""))
    return c.table("part").select("p_partkey", tx.last_rule(said, [("strong", "HIGH"), ("soft", "LOW")], "MEDIUM").alias("intensity"))


@query("txt21_avoid_several", "select p_partkey, case when p_size % 3 = 0 then '' else p_name || '+' || lower(p_type) end as avoided from part")
def _(c):
    """All parts; a third of the wishes avoid nothing, the others two things."""
    wish = F.concat(F.lit("gladly "), "p_name", F.when(F.col("p_size") % 3 == 0, "; no more").otherwise(F.concat(F.lit(" but not "), F.upper("p_name"), F.lit(", and not "), "p_type", F.lit("! thanks"))))
    return c.table("part").select("p_partkey", F.array_join(tx.after_cue(wish, "not "), "+").alias("avoided"))


_SIDES = "with r as (select p_partkey, string_split(p_name, ' ') as likes, [split_part(p_name, ' ', case when p_size % 2 = 0 then 1 else 2 end)] as avoids, [lower(p_type)] as more from part)"


def sides(c):
    w = F.split("p_name", " ")
    return c.table("part").select("p_partkey", w.alias("likes"), F.array(F.when(F.col("p_size") % 2 == 0, w[0]).otherwise(w[1])).alias("avoids"), F.array(F.lower("p_type")).alias("more"))


@query("txt22_rule_merge", _SIDES + " select p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(likes, lambda x: not list_contains(avoids, x)), more))), '+') as merged from r")
def _(c):
    return sides(c).select("p_partkey", F.array_join(F.array_sort(F.array_union(F.array_except("likes", "avoids"), "more")), "+").alias("merged"))


@query("txt24_bridge_expansion", twin("feat tok", _LIFT + ", bg as (select token, feature from l where p >= 0.2 and lift >= 1.1) select distinct p_partkey, feature from part join bg on bg.token = lower(p_name)"))
def _(c):
    bridge = lift(c).filter("p >= 0.2 and lift >= 1.1").select("token", "feature")
    return c.table("part").join(bridge, F.lower("p_name") == F.col("token")).select("p_partkey", "feature").distinct()


@query("txt25_unmatched_reasons", "with z as (select 1)" + _HITS + ", c as (select p_partkey, bool_or(contains(p_name, surface)) as any_ from part, sf group by 1) select c.p_partkey, case when not any_ then 'NOT_IN_LEXICON' when h.p_partkey is null then 'CONDITION_NOT_MET' when not core then 'NOT_CORE' end as reason from c left join (select p_partkey, bool_or(feature = 'warm') as core from ht group by 1) h on h.p_partkey = c.p_partkey where not any_ or h.p_partkey is null or not core")
def _(c):
    lex = F.broadcast(lexicon(c))
    seen = c.table("part").join(lex, F.col("p_name").contains(F.col("surface"))).select("p_partkey").distinct().withColumn("seen", F.lit(True))
    met = hits(c).groupBy("p_partkey").agg(F.bool_or(F.col("feature") == "warm").alias("core"))
    rows = c.table("part").select("p_partkey").join(seen, "p_partkey", "left").join(met, "p_partkey", "left")
    reason = F.when(F.col("seen").isNull(), "NOT_IN_LEXICON").when(F.col("core").isNull(), "CONDITION_NOT_MET").when(~F.col("core"), "NOT_CORE")
    return rows.withColumn("reason", reason).filter("reason is not null").select("p_partkey", "reason")


@query("txt26_estimator_cache", "select p_partkey, case when p_size % 3 = 0 then 'asked: none' when p_size % 3 = 1 then 'asked: warm' else 'never asked' end as state from part")
def _(c):
    # Three states: no row was never asked; an empty array was asked without result.
    cache = c.frame([(0, []), (1, ["warm"])], "k int, found array<string>")
    rows = c.table("part").withColumn("k", F.col("p_size") % 3).join(F.broadcast(cache), "k", "left")
    state = F.when(F.col("found").isNull(), "never asked").when(F.size("found") == 0, "asked: none").otherwise(F.concat(F.lit("asked: "), F.array_join("found", "+")))
    return rows.select("p_partkey", state.alias("state"))


@query("txt27_title_flags", _T + " select p_partkey, regexp_matches(lower(title), '[0-9]ml|[0-9] ml') as has_volume, contains(title, '[') as has_bracket, contains(title, '+') as has_extra, regexp_matches(lower(title), 'edp|eau de parfum') as is_edp from t")
def _(c):
    low = F.lower("title")
    return titles(c).select("p_partkey", low.rlike("[0-9] ?ml").alias("has_volume"), F.col("title").contains("[").alias("has_bracket"), F.col("title").contains("+").alias("has_extra"), low.rlike("edp|eau de parfum").alias("is_edp"))


@query("txt28_volumes", "select p_partkey, case p_size % 4 when 0 then '30.0|50.0' when 1 then '100.0' when 2 then '7.5' else '' end as volumes from part")
def _(c):
    return titles(c).select("p_partkey", F.array_join(F.transform(tx.volumes(F.col("title")), lambda v: v.cast("string")), "|").alias("volumes"))


@query("txt29_concentrations", "select p_partkey, case p_size % 4 when 0 then 'EDP' when 1 then 'EDT' when 2 then '' else 'Extrait|EDP' end as labels from part")
def _(c):
    return titles(c).select("p_partkey", F.array_join(tx.concentrations(F.col("title")), "|").alias("labels"))


@query("txt30_product_form", _T + " select p_partkey, case when contains(title, 'mini') then 'MINI' when contains(title, 'pouch') then 'SET' when regexp_matches(lower(title), 'parfum|edt') then 'PERFUME' else 'OTHER' end as form from t")
def _(c):
    low = F.lower("title")
    return titles(c).select("p_partkey", F.when(low.contains("mini"), "MINI").when(low.contains("pouch"), "SET").when(low.rlike("parfum|edt"), "PERFUME").otherwise("OTHER").alias("form"))


@query("txt31_cleaned_name", "select p_partkey, p_name as name from part")
def _(c):
    return titles(c).select("p_partkey", tx.cleaned_name(F.col("title"), F.col("p_brand")).alias("name"))


@query("txt32_provenance", "select p_partkey, lower(p_brand) || ' ' || p_name || case p_size % 4 when 2 then ' (mini)' when 3 then ' extrait de parfum' else '' end as clean, case p_size % 4 when 2 then '[SALE]|+ pouch' else '[SALE]' end as noise from part")
def _(c):
    r = titles(c).select("p_partkey", tx.normalised_with_provenance("title").alias("r"))
    return r.select("p_partkey", F.col("r.clean").alias("clean"), F.array_join("r.noise", "|").alias("noise"))


@query("txt33_morphology_keys", "with v as (select distinct p_name as w from part union select distinct replace(upper(p_name), ' ', '-') || 'S' from part) select regexp_replace(regexp_replace(lower(w), '[^a-z0-9]', '', 'g'), 's$', '') as key, count(*) as forms from v group by 1 having count(*) > 1")
def _(c):
    n = c.table("part").select(F.col("p_name").alias("w")).distinct()
    v = n.unionByName(n.select(F.concat(F.replace(F.upper("w"), F.lit(" "), F.lit("-")), F.lit("S")).alias("w"))).distinct()
    key = F.regexp_replace(F.regexp_replace(F.lower("w"), "[^a-z0-9]", ""), "s$", "")
    return v.groupBy(key.alias("key")).agg(F.count("*").alias("forms")).filter("forms > 1")


@query("txt34_match_cascade", "select p_partkey, case when p_size % 3 = 0 then 'exact' when p_size % 3 = 1 then 'normalised' else 'none' end as basis from part")
def _(c):
    known = c.table("part").select(F.col("p_name").alias("k")).distinct()
    said = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.replace(F.upper("p_name"), F.lit(" "), F.lit("-"))).otherwise("?")
    rows = c.table("part").select("p_partkey", said.alias("said"))
    exact = known.select(F.col("k").alias("said"), F.lit(True).alias("exact"))
    norm = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    loose = known.select(norm("k").alias("n"), F.lit(True).alias("loose")).distinct()
    rows = rows.join(exact, "said", "left").withColumn("n", norm("said")).join(loose, "n", "left")
    return rows.select("p_partkey", F.when(F.col("exact"), "exact").when(F.col("loose"), "normalised").otherwise("none").alias("basis"))


@query("txt35_canonical_idf", twin("tok", ", m as (select item, unnest(list_distinct(list(split_part(token, ' ', 2)))) as token from tok group by item), n as (select count(distinct item) as n from m) select token, count(*) as df, round(ln((n + 1) / (count(*) + 1)) + 1, 6) as idf from m, n group by token, n"))
def _(c):
    from ..operators.similarity import idf

    canon = c.tok.select("item", F.split_part("token", F.lit(" "), F.lit(2)).alias("token")).distinct()
    return idf(canon).select("token", "df", F.round("idf", 6).alias("idf"))


@query("txt36_typos")
def _(c):
    """Every kind of slip, one row per part and kind."""
    rows = syllables(c)
    made = [rows.select("p_partkey", F.lit(kind).alias("kind"), "said", tx.slipped("said", kind).alias("typed")) for kind in hangul.SLIPS]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


#: Words of promotion, size, form and strength around a part's name, as shops write them.
_SHOP = ("{n} EDP 50ml (+ 바디로션 증정)", "[단독기획] {n} 오 드 뚜왈렛 30/50ml 세트", "{b} {n} 헤어 미스트 100ml", "{n} Extrait de Parfum 7.5 ml 2종", "고체 {n} 퍼퓸 밤", "{b}: {n} 롤온 eau de cologne 10g", "[{n}] EDP 리필 택1", "{n} discovery set 3개 PICK")


def shop_titles(c):
    """Part names as shop titles of eight kinds."""
    kinds = [F.replace(F.replace(F.lit(t), F.lit("{n}"), F.col("p_name")), F.lit("{b}"), F.col("p_brand")) for t in _SHOP]
    return c.table("part").select("p_partkey", "p_name", "p_brand", F.element_at(F.array(*kinds), (F.col("p_size") % 8 + 1).cast("int")).alias("title"))


@query("txt27_mentions")
def _(c):
    found = {flag: F.size(x).cast("int").alias(flag) for flag, x in titles_of.mentions(F.col("title")).items()}
    return shop_titles(c).select("p_partkey", "title", *found.values())


_IDENTITY = """select p_partkey, p_name || case p_size % 8 when 1 then ' 30' when 6 then ' 리필' when 7 then ' discovery set' else '' end as core_name,
  case p_size % 8 when 0 then 'EDP' when 1 then 'EDT' when 3 then 'EXTRAIT' when 5 then 'EDC' when 6 then 'EDP' else '' end as concentrations,
  case p_size % 8 when 2 then 'HAIR_FRAGRANCE' when 4 then 'SOLID_FRAGRANCE' when 5 then 'ROLL_ON' else 'LIQUID_PERFUME' end as product_form,
  case p_size % 8 when 2 then p_brand || ' ' when 5 then p_brand || ': ' else '' end as brand_prefix,
  case p_size % 8 when 0 then '(+ 바디로션 증정)|50ml' when 1 then '[단독기획]|50ml|세트' when 2 then '100ml' when 3 then '7.5 ml|2종' when 4 then '' when 5 then '10g' when 6 then '택1' else '3개|PICK' end as noise from part"""


@query("txt32_identity", _IDENTITY)
def _(c):
    rows = titles_of.identity(shop_titles(c), "title", "p_brand")
    return rows.select("p_partkey", "identity.core_name", F.array_join("identity.concentrations", "|").alias("concentrations"), "identity.product_form", "identity.brand_prefix", F.array_join("identity.noise", "|").alias("noise"))



@query("txt38_leakage_checks", "select doc_id, length(text) > 100 as too_long, contains(text, '@') as has_mail, n > 1 as duplicate from (select *, count(*) over (partition by text) as n from documents)")
def _(c):
    # Counted by digest, so that whole texts don't travel.
    d = c.table("documents").select("doc_id", (F.char_length("text") > 100).alias("too_long"), F.col("text").contains("@").alias("has_mail"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    n = d.groupBy("h").agg(F.count("*").alias("n"))
    return d.join(n, "h").select("doc_id", "too_long", "has_mail", (F.col("n") > 1).alias("duplicate"))


@query("txt39_concept_expansion", twin("feat tok", _LIFT + ", bg as (select token, feature, lift from l where lift >= 1.3), sp as (select feature, count(*) as df from feat group by 1), w as (select token, feature, ln((select count(distinct item) from feat) / greatest(df, 1)) as w from bg join sp using (feature)) select token, feature, round(w / sum(w) over (partition by token), 6) as weight from w"))
def _(c):
    from ..operators.cooccurrence import support

    n = F.broadcast(c.feat.agg(F.count_distinct("item").alias("n")))
    w = lift(c).filter("lift >= 1.3").join(support(c.feat), "feature").crossJoin(n).withColumn("w", F.ln(F.col("n") / F.greatest("support", F.lit(1))))
    return w.select("token", "feature", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("token")), 6).alias("weight"))


@query("txt40_avoid_routing", "select p_partkey, case when split_part(p_name, ' ', 2) in ('ring', 'bolt') then 'HARD' when split_part(p_name, ' ', 1) = 'hot' then 'SOFT' else 'NO_MAP' end as route from part")
def _(c):
    exact = F.broadcast(c.frame([("ring",), ("bolt",)], "w string").withColumn("hard", F.lit(True)))
    soft = F.broadcast(c.frame([("hot", "relates")], "v string, kind string"))
    p = c.table("part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("v"))
    return p.join(exact, "w", "left").join(soft, "v", "left").select("p_partkey", F.when(F.col("hard"), "HARD").when(F.col("kind") == "relates", "SOFT").otherwise("NO_MAP").alias("route"))


@query("txt41_evidence_suppression", _SIDES + " select p_partkey, len(list_filter(likes, lambda x: not list_contains(avoids, x))) as kept, len(list_intersect(likes, avoids)) > 0 as any_hit from r")
def _(c):
    evidence = F.transform("likes", lambda x: F.struct(x.alias("feature"), F.lit("name").alias("source")))
    left = F.filter(evidence, lambda e: ~F.array_contains(F.col("avoids"), e["feature"]))
    return sides(c).select("p_partkey", F.size(left).alias("kept"), F.arrays_overlap("likes", "avoids").alias("any_hit"))


@query("txt42_alias_review", _NAMES + ", x as (select distinct split_part(w, ' ', 2) as a from v) select a, w as entry from x join v on contains(w, a) and w <> a")
def _(c):
    v = c.table("part").select(F.col("p_name").alias("entry")).distinct()
    a = v.select(F.split_part("entry", F.lit(" "), F.lit(2)).alias("a")).distinct()
    return v.join(a, F.col("entry").contains(F.col("a")) & (F.col("entry") != F.col("a"))).select("a", "entry")


@query("txt43_version_gate", "select 0::bigint as changed")
def _(c):
    from ..operators.checks import same_rows

    old = hits(c).filter("feature <> 'light'").select("p_partkey", "feature")
    new = hits(c).filter("expression <> 'small gizmo'").select("p_partkey", "feature")
    return same_rows(old, new, "gate").select(F.col("detail").alias("changed"))
