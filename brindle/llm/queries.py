"""The driver's queries over the corpus tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import chat, decontaminate, forest, lm, minhash, packing, rlz, suffixes, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.repeats(_table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return forest.neighbours(vectors, vectors.where("vec_id % 50 = 0"))  # the stated query set, against all rows


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("is_toxic")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.match(_table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(_table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_turns(_table(spark, sf_dir, "conversations"), {"chatml": chat.chatml, "last_answer": chat.last_answer})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": op5_url_filters,
    "op6_decontaminate": op6_decontaminate,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_chat_formatting": op10_chat_formatting,
}

_CHAT_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as position,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as piece from said
), ended as (
  select *, sum(length(piece)) over (partition by conv_id order by position) as span_end from ordered
), marked as (
  -- the answers: all but the last one of a rendering shrink to three dots
  select conv_id, position, turn, role, text, role = 'assistant' as answer,
         '<' || role || '>' || text || '</' || role || '>' as whole,
         '<' || role || '>' || case when role = 'assistant' then '...' else text end || '</' || role || '>' as short,
         max(case when role = 'assistant' then position end) over (partition by conv_id order by position rows between unbounded preceding and 1 preceding) as previous,
         max(case when role = 'assistant' then position end) over (partition by conv_id) as last_answer
  from ordered
), placed as (
  select *, coalesce(sum(length(short)) over (partition by conv_id order by position rows between unbounded preceding and 1 preceding), 0) as short_start from marked
), joined as (
  -- the rendering before a turn ends where its short form would, and the last answer's rest
  select a.*, b.short_start + length('<assistant>') + case when b.text like '...%' then 3 when b.text like '..%' then 2 when b.text like '.%' then 1 else 0 end as parting,
         b.text as old_text, a.short_start + coalesce(length(b.whole) - length(b.short), 0) as before_end
  from placed a left join placed b on a.conv_id = b.conv_id and a.previous = b.position
), turned as (
  -- a text of dots alone parts where its own end tag meets the dots; three dots don't change
  select *, coalesce(answer and old_text <> '...', false) as rewrites from joined
), spans as (
  select *, case when rewrites then parting else before_end end as own_start,
         case when rewrites or answer then short_start + length(whole) else before_end + length(whole) end as own_end,
         min(case when rewrites then parting end) over (partition by conv_id order by position rows between 1 following and unbounded following) as cut
  from turned
), rendered as (
  select conv_id, string_agg(case when position = last_answer then whole else short end, '' order by position) as text from placed group by conv_id
), least_spans as (
  select *, least(own_start, coalesce(cut, own_start)) as s, least(own_end, coalesce(cut, own_end)) as e from spans
)
select 'chatml' as template, conv_id, position::INTEGER as position, turn, role, (span_end - length(piece))::INTEGER as span_start, span_end::INTEGER as span_end, piece, false as rewrites from ended
union all
select 'last_answer', conv_id, position::INTEGER, turn, role, s::INTEGER, e::INTEGER, substr(r.text, s::BIGINT + 1, (e - s)::BIGINT), rewrites from least_spans join rendered r using (conv_id)
"""

#: Training, dedup groups, parses, plans and fitted mixtures are beyond SQL; the tests hold them against brute force.
ORACLES: dict[str, str] = {"op5_url_filters": urlfilter.rules_sql(), "op10_chat_formatting": _CHAT_SQL}
