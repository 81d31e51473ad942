"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embed_dedup, mixing, quality, sharding, simhash, token_counts, token_store, toxicity
from .common import Scratch

#: The target mix of op10 and of the pipeline.
WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 6, "*": 2}, "source": {"*": 1}}
SEED = 17


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.balanced_shards(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.format_turns(turns))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-store")
    return token_store.read_tokens(*token_store.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), scratch))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.hamming_classes(_table(spark, sf_dir, "documents"), 3, 2)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.linked_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(_table(spark, sf_dir, "documents"), WEIGHTS, seed=SEED)
    return out.select(F.col("id").alias("doc_id"), "domain", "lang", "source", F.col("tokens").cast("long").alias("tokens"), F.col("epoch").cast("int").alias("epoch"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_sharding, op2_chat_format, op3_token_store, op4_toxicity, op5_quality, op6_decontamination, op7_simhash, op8_token_counts, op9_embedding_dedup, op10_mixing)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def _level(name: str, above: str, keys: list[str], up: str) -> str:
    """One level of the water-filling of mixing.budgets: rows of table ``above`` (keys, room, w) get their budget."""
    parents = ", ".join(keys[:-1])
    by = f"partition by {parents}" if parents else ""
    join = f"join {up} u on " + " and ".join(f"r.{k} is not distinct from u.{k}" for k in keys[:-1]) if parents else f"cross join {up} u"
    own = ", ".join(f"r.{k}" for k in keys)
    return f"""
{name}_a as (select {own}, r.room, r.w, u.budget as up from {above} r {join}),
{name}_b as (select *, coalesce(sum(room) over (o rows between unbounded preceding and 1 preceding), 0) as used,
    sum(w) over (o rows between current row and unbounded following) as rest_w from {name}_a
    window o as ({by} order by room::double / w::double asc nulls last, {keys[-1]} asc nulls first)),
{name}_c as (select *, room::double * rest_w::double <= (up - used)::double * w::double as is_full from {name}_b),
{name}_d as (select *, max(case when not is_full then up - used end) over ({by}) as left_over,
    max(case when not is_full then rest_w end) over ({by}) as share_w from {name}_c),
{name} as (select {", ".join(keys)}, case when is_full then room else (left_over * w) // share_w end as budget from {name}_d)"""


def _mixing_sql() -> str:
    weight = lambda level: "case " + " ".join(f"when {level} = '{k}' then {v}" for k, v in WEIGHTS[level].items() if k != "*") + f" else {WEIGHTS[level].get('*', 1)} end" if set(WEIGHTS[level]) != {"*"} else str(WEIGHTS[level]["*"])
    return f"""
with d as (select doc_id, md5(coalesce(text, '')) as tie, coalesce((strlen(text) + 3) // 4, 0)::bigint as tokens, lang, source,
    case when regexp_extract(coalesce(source, ''), '([0-9])$', 1) in ('0', '1', '2', '3') then 'web'
         when regexp_extract(coalesce(source, ''), '([0-9])$', 1) in ('4', '5', '6') then 'books'
         when regexp_extract(coalesce(source, ''), '([0-9])$', 1) in ('7', '8', '9') then 'forum' else 'other' end as domain from documents),
leaves as (select domain, lang, source, sum(tokens)::hugeint as tokens from d group by all),
r3 as (select *, tokens * 2 as room, {weight("source")} as w from leaves),
r2 as (select domain, lang, sum(room) as room, {weight("lang")} as w from r3 group by domain, lang),
r1 as (select domain, sum(room) as room, {weight("domain")} as w from r2 group by domain),
u0 as (select least(sum(room), (select sum(tokens) from leaves)) as budget from r1),
{_level("b1", "r1", ["domain"], "u0")},
{_level("b2", "r2", ["domain", "lang"], "b1")},
{_level("b3", "r3", ["domain", "lang", "source"], "b2")},
plan as (select b.domain, b.lang, b.source, case when l.tokens > 0 then b.budget // l.tokens else 0 end as whole,
    b.budget - (case when l.tokens > 0 then b.budget // l.tokens else 0 end) * l.tokens as part from b3 b join leaves l
    on b.domain is not distinct from l.domain and b.lang is not distinct from l.lang and b.source is not distinct from l.source),
e as (select d.*, p.whole, p.part, md5('{SEED}' || ':' || p.whole::bigint::varchar || ':' || coalesce(doc_id::varchar, 'null') || ':' || tie) as place from d join plan p
    on d.domain is not distinct from p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source),
f as (select *, sum(tokens) over (partition by domain, lang, source order by place) <= part and part > 0 as inside from e),
g as (select *, (whole + case when inside then 1 else 0 end)::bigint as copies from f)
select doc_id, domain, lang, source, tokens, epoch::int as epoch from (select *, unnest(range(copies)) as epoch from g where copies > 0)
"""


#: The template's opening strings by role, the legal successors of each state, as chat.DEFAULT has them.
_CHAT_SQL = r"""
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s as (select *, case when role in ('system', 'user', 'assistant', 'tool') then role else '<other>' end as state,
    length(text) * 5 - length(replace(text, '\', '')) - length(replace(text, '#', '')) - length(replace(text, ']', '')) - length(replace(text, '<', '')) as body,
    case role when 'system' then 12 when 'user' then 10 when 'assistant' then 15 when 'tool' then 10 else 8 + length(coalesce(role, '')) * 5 - length(replace(coalesce(role, ''), '\', '')) - length(replace(coalesce(role, ''), '#', '')) - length(replace(coalesce(role, ''), ']', '')) - length(replace(coalesce(role, ''), '<', '')) end as opening from t),
o as (select *, row_number() over w as i, coalesce(lag(state) over w, '<start>') as before, lead(state) over w is null as last from s window w as (partition by conv_id order by turn nulls first, role nulls first, text)),
v as (select *, (before = '<start>' and state in ('system', 'user') or before = 'system' and state = 'user' or before = 'user' and state = 'assistant' or before = 'assistant' and state in ('user', 'tool') or before = 'tool' and state = 'assistant')
    and (not last or state = 'assistant') as valid from o)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by i)) as turns_sha256, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256, sum(opening + body + 8)::bigint as formatted_chars, bool_and(valid) as all_valid from v group by conv_id
"""

_VECTORS_SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
fine as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
near as (select a.vec_id as p, b.vec_id as q from fine a join fine b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93::double),
c(vec_id, label) using key (vec_id) as (select vec_id, vec_id from v union
    select n.q, min(c.label) from c join near n on n.p = c.vec_id join recurring.c o on o.vec_id = n.q where c.label < o.label group by n.q)
select c.vec_id, (select count(*) from near where p = c.vec_id)::bigint as n_links, c.label as component_id, c.vec_id = c.label as kept from c
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": _CHAT_SQL, "op9_embedding_dedup": _VECTORS_SQL, "op10_mixing": _mixing_sql()}
