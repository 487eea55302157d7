"""The ten training-data queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe_fst, licenses, media_gif, near_dedup, packing, quality, substring_dedup, token_store, topk, toxicity
from foliant.llm.common import table
from foliant.llm.tokens import vocabulary


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_gif.payload_rows(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = token_store.Layout(vocabulary("word_bpe_49k.json"), keeps_space=False, end_id=1)
    path = token_store.write_store(table(spark, sf_dir, "documents"), layout)
    return token_store.read_store(spark, path, layout)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_fst.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


NEAR_DEDUP_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, array_to_string(w, ' ') as whole,
    case when len(w) = 0 then []
         when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end as s
  from w
), c as (
  select whole, min(doc_id) as copy_of, any_value(s) as s from s group by whole
), g as (
  select copy_of, g, count(*) as n from (select copy_of, unnest(s) as g from c) group by all
), t as (
  select copy_of, sum(n) as n from g group by all
), p as (
  select a.copy_of as a, b.copy_of as b, sum(least(a.n, b.n)) as common
  from g a join g b on a.g = b.g and a.copy_of < b.copy_of group by all
), e as (
  select a, b from p join t x on x.copy_of = a join t y on y.copy_of = b
  where common::double / (x.n + y.n - common)::double >= 0.8
), both_ways as (
  select a, b from e union all select b, a from e
), reach(id, root) as (
  select copy_of, copy_of from c
  union
  select b.b, r.root from reach r join both_ways b on b.a = r.id where r.root < b.b
), r as (
  select id as copy_of, min(root) as class_id from reach group by id
), d as (
  select s.doc_id, r.class_id, c.copy_of from s join c using (whole) join r using (copy_of)
)
select doc_id, class_id, count(*) over (partition by class_id) as class_size, copy_of from d
"""

SUBSTRING_DEDUP_SQL = """
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), place as (
  select doc_id, w, unnest(range(1, len(w) - 33)) as i from w where len(w) >= 35
), win as (
  select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as h from place
), again as (
  select h from win group by h having count(*) > 1
), gone as (
  select distinct doc_id, i + o as p from win join again using (h), range(0, 35) t(o)
), kept as (
  select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from w) x anti join gone using (doc_id, p)
  group by doc_id
)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_gif_media, op3_near_dedup, op4_token_store, op5_quality, op6_toxicity, op7_packing, op8_bpe_round_trip, op9_exact_top_k, op10_substring_dedup)
}

#: The others run tokenizers, trained models or media formats: tests hold them against
#: brute force, exact round trips and held-out labels.
ORACLE_SQL = {"op1_license_scan": licenses.scan_sql(), "op3_near_dedup": NEAR_DEDUP_SQL, "op9_exact_top_k": topk.TOP_K_SQL, "op10_substring_dedup": SUBSTRING_DEDUP_SQL}
