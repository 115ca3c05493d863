"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, flac, langid, packing, pii, quality, simhash, suffixes, warc
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.windows(rows))


OP7_SQL = r"""
with recursive c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t as (
  select *, row_number() over (partition by conv_id order by turn, role, text) - 1 as i,
    len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 4 as tokens,
    length(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) as size from c
), u as (select *, sum(tokens) over (partition by conv_id order by i rows unbounded preceding) as upto from t
), r as (
  select conv_id, greatest(1, 1024 - 256 - coalesce(max(case when i = 0 and role = 'system' then tokens end), 0)) as room, bool_or(i = 0 and role = 'system') as sys from u group by 1
), spans(conv_id, k, start, base) as (
  select conv_id, 0, 0::bigint, 0::hugeint from r
  union all select s.conv_id, s.k + 1, min(u.i), min(u.upto - u.tokens) from spans s join r on r.conv_id = s.conv_id
    join u on u.conv_id = s.conv_id and u.i > s.start and u.upto - s.base > r.room group by s.conv_id, s.k
), w as (select *, coalesce(lead(start) over (partition by conv_id order by k), 9999999) as fin from spans
), held as (
  select u.conv_id, 8 + length(u.role) + u.size as chars from w join r on r.conv_id = w.conv_id join u on u.conv_id = w.conv_id and u.i < w.fin
    and (u.i >= w.start or (r.sys and u.i = 0) or w.base - u.upto + u.tokens <= 256)
), f as (select conv_id, sum(chars)::bigint as formatted_chars from held group by 1
), d as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
    coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '') as loss from u group by 1
)
select conv_id, n_turns, turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from d join f using (conv_id)
"""


#: Key of the surrogates in the queries here; production jobs pass their own.
PII_KEY = "weftgraph-demo-key"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.audit(pages, warc.damaged(pages))


OP2_SQL = """
with src as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html, substr(md5(coalesce(url, '')), 1, 2) as d from pages
), replica as (
  select page_id, url, case when d = '00' then 'X' || substr(html, 2) else html end as html from src where d <> '01'
  union all select -page_id - 2, url, html from src where d = '02'
), records as (
  select 'a' as side, page_id, url, html from src union all select 'b', page_id, url, html from replica
), texts as (
  select side, page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
    || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) as r from records
), sized as (
  select side, page_id, page_id >> 10 as segment, strlen(r)::bigint as record_length, sha256(r) as sha from texts
), placed as (
  select *, sum(record_length) over (partition by side, segment order by page_id rows unbounded preceding) - record_length as record_offset from sized
), a as (select * from placed where side = 'a'), b as (select * from placed where side = 'b')
select coalesce(a.page_id, b.page_id) as page_id, case when b.sha is null then 'missing' when a.sha is null then 'extra' else 'corrupt' end as status,
  coalesce(a.segment, b.segment)::bigint as segment, coalesce(a.record_offset, b.record_offset)::bigint as record_offset,
  coalesce(a.record_length, b.record_length) as record_length, a.sha as expected_sha256, b.sha as found_sha256
from a full join b on a.page_id = b.page_id where a.sha is distinct from b.sha
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.grade(docs, model).select("doc_id", "expected_grade", "p_not_toxic", "p_good", "selected")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.held_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_warc_fixity, op3_quality, op4_decontaminate, op5_flac, op6_packing, op7_chat, op8_pii, op9_suffixes, op10_langid)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_fixity": OP2_SQL, "op7_chat": OP7_SQL}
