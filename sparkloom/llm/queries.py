"""The llm operators' registered queries and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, exact_dedup, lm_score, ngram_join, pii, quality, sharding, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_groups(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.format_chats(turns))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(_table(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_score.score(_table(spark, sf_dir, "documents"), good)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


_CONTROL = "|".join(c.replace("|", "[|]").replace("[INST]", r"\[INST\]").replace("[/INST]", r"\[/INST\]") for c in chat_format.CONTROL)

_OP1_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as n from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by n) as group_size,
       doc_id = first_value(doc_id) over w as kept, sha256(n) as text_sha256
from d window w as (partition by n order by length(t) desc, doc_id)
"""

_OP4_SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
             length(text) + len(regexp_extract_all(text, '{_CONTROL}')) as escaped from t)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(escaped) + sum(case when before is null or before <> role then 9 + length(role) + 1 + 9 else 10 end) as bigint) as formatted_chars
from m group by conv_id
"""

_OP10_SQL = r"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(rule_host, rule_path, action) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f as (select page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule, max_by(action, length(rule_host || rule_path)) as action
      from p join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from p left join f using (page_id)
"""


_OP5_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
g as (select distinct item_id, array_to_string(list_slice(w, i, i + 9), ' ') as gram, least(len(w), 10) as n
      from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, least(len(w), 1)))) as i from b)),
m as materialized (select doc_id, item_id, i, n from
      (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as gram from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from g))) join g using (gram, n)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""

_OP6_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as materialized (select distinct doc_id, array_to_string(list_slice(words, i, i + 4), ' ') as shingle from (select doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, least(len(words), 1)))) as i from w)),
c as materialized (select doc_id, count(*) as n from s group by doc_id),
l as materialized (select a.doc_id as u, b.doc_id as v from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id join c ca on ca.doc_id = a.doc_id join c cb on cb.doc_id = b.doc_id
      group by a.doc_id, b.doc_id, ca.n, cb.n having 100 * count(*) >= 80 * (ca.n + cb.n - count(*))),
r as (select doc_id as node, doc_id as reached from w union select r.node, l.v from r join l on l.u = r.reached)
select w.doc_id, coalesce(c.n, 0) as n_shingles, m.component_id
from w left join c using (doc_id) join (select node, min(reached) as component_id from r group by node) m on m.node = w.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality": op2_quality,
        "op3_bpe": op3_bpe,
        "op4_chat_format": op4_chat_format,
        "op5_decontaminate": op5_decontaminate,
        "op6_ngram_join": op6_ngram_join,
        "op7_pii": op7_pii,
        "op8_sharding": op8_sharding,
        "op9_lm_score": op9_lm_score,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1_SQL, "op4_chat_format": _OP4_SQL, "op5_decontaminate": _OP5_SQL, "op6_ngram_join": _OP6_SQL, "op10_url_filter": _OP10_SQL}
