"""The operators' queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import chat, decontaminate, embeddings, language, mixing, pii, quality, sharding, simhash, toxicity

CONTROL = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), spans=True)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.sharded(docs.select("doc_id")).select("doc_id", "shard")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    return chat.digest(chat.formatted(rows.union(own)))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix": op4_mix,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_embeddings": op7_embeddings,
    "op8_pii": op8_pii,
    "op9_shard": op9_shard,
    "op10_chat": op10_chat,
}

_MOVES = ", ".join(f"('{a}', '{b}')" for a, ends in chat.DEFAULT.follows.items() for b in ends)
_LAST = ", ".join(f"'{r}'" for r in chat.DEFAULT.last)
_NUMBER = f"cast('0x' || substr(md5({{}}), 1, {sharding.DIGITS}) as bigint)"

ORACLES = {
    "op7_embeddings": f"""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) x from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len([c for c in embedding if c is null or isnan(c) or isinf(c)]) = 0
    and len([c for c in embedding if c <> 0]) > 0
), link as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and len(a.x) = len(b.x) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.x, b.x) >= {embeddings.COSINE}
), reach as (
  select vec_id a, vec_id b from embeddings
  union
  select reach.a, link.b from reach join link on reach.b = link.a
), comp as (select a, min(b) component_id from reach group by a)
select e.vec_id, (select count(*) from link where link.a = e.vec_id) n_links, c.component_id, e.vec_id = c.component_id kept
from embeddings e join comp c on c.a = e.vec_id""",
    "op9_shard": f"""
with recursive shards as (
  select i, {_NUMBER.format("'shard-' || i || '/start'")} % {sharding.SLOTS} as s0,
    {_NUMBER.format("'shard-' || i || '/step'")} % {sharding.SLOTS - 1} + 1 as st
  from range({sharding.SHARDS}) t(i)
), liked as (
  select i, [(s0 + j * st) % {sharding.SLOTS} for j in range({sharding.SLOTS})] as p from shards
), fill(n, held, slot, shard) as (
  select 0, cast([] as bigint[]), cast(null as bigint), cast(null as bigint)
  union all
  select n + 1, list_append(held, taken), taken, i
  from (
    select f.n, f.held, l.i, [x for x in l.p if not list_contains(f.held, x)][1] taken
    from fill f join liked l on l.i = f.n % {sharding.SHARDS} where f.n < {sharding.SLOTS}
  )
)
select d.doc_id, cast(f.shard as integer) shard from documents d
join fill f on f.slot = {_NUMBER.format("coalesce(cast(d.doc_id as varchar), '')")} % {sharding.SLOTS}""",
    "op10_chat": f"""
with given as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '{CONTROL}' union all select -1, 1, 'assistant', '{CONTROL}'
), told as (
  select *, row_number() over w - 1 as k, coalesce(lag(r) over w, '') as before, count(*) over (partition by conv_id) as n
  from given window w as (partition by conv_id order by turn nulls first, r, t)
), t as (
  select *, case when (before, r) not in ({_MOVES}) then k when k = n - 1 and r not in ({_LAST}) then n end as wrong from told
)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by k)) turns_sha256,
  cast(sum(case when r = 'assistant' then length(t) else 0 end) as bigint) loss_chars,
  sha256(coalesce(string_agg(case when r = 'assistant' then t else '' end, '' order by k), '')) loss_sha256,
  cast(sum({len(chat.DEFAULT.start) + 1 + len(chat.DEFAULT.end)}
    + length(replace(replace(replace(r, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\/'))
    + length(replace(replace(t, '\\', '\\\\'), '<|', '<\\|'))) as bigint) formatted_chars,
  count(wrong) = 0 as valid, cast(min(wrong) as integer) bad_turn
from t group by conv_id""",
}
