"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, chat, filter_audit, katz, language, near_dup, packing, quality, token_counts, token_files, top_k, vector_dups
from .common import crc32_mod, table, work_dir


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.expr(crc32_mod("doc_id", 7) + " = 2"), F.lit(False))
    return katz.score_documents(table(spark, sf_dir, "documents"), held_out)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pack_documents(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=1)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, path)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.expr(crc32_mod("doc_id", 4) + " = 2"), F.lit(False))
    found = language.identify(docs, language.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


#: A conversation whose texts hold the template's own control strings.
CONTROL = "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(more)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"))


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


OP10_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), s as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w
), c as materialized (
  select min(doc_id) as cid, len(any_value(s)) as n, any_value(s) as s from s where len(s) > 0 group by list_sort(s)
), x as materialized (select cid, n, unnest(s) as t from c),
l as materialized (
  select a.cid as a, b.cid as b from x a join x b on a.t = b.t and a.cid < b.cid and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
  group by a.cid, b.cid, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e as materialized (select a, b from l union select b, a from l),
r as (select cid as a, cid as b from c union select r.a, e.b from r join e on r.b = e.a),
k as (select a as cid, min(b) as component_id from r group by a),
d as (select s.doc_id, len(s.s) as n_shingles, min(s.doc_id) over (partition by list_sort(s.s)) as cid from s)
select doc_id, cast(n_shingles as bigint) as n_shingles,
  case when n_shingles = 0 then doc_id else component_id end as component_id,
  doc_id = case when n_shingles = 0 then doc_id else component_id end as kept
from d left join k using (cid)
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


def op12_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
with recursive v as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as materialized (
  select a.r as a, b.r as b, b.vec_id from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r where list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (select r as a, r as b, vec_id from v union select reach.a, l.b, l.vec_id from reach join l on reach.b = l.a),
c as (select a, min(vec_id) as component_id from reach group by a),
n as (select a, count(*) as n_links from l group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, vec_id is not distinct from component_id as kept from v join c on r = c.a left join n on r = n.a
union all
select vec_id, 0, vec_id, true from embeddings
where label is null or embedding is null or len(list_filter(embedding, lambda x: x is null or not isfinite(x))) > 0 or len(list_filter(embedding, lambda x: x <> 0)) = 0
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = """
with recursive t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents
), w as (
  select *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by text) as first from t
), l as (
  select doc_id, bool_or(coalesce(quality, 0) = 1) as good, bool_or(coalesce(toxic, 0) = 1) as toxic from labels group by doc_id
), m as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] as f
  from w left join l using (doc_id)
), c as (
  select part, f, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from m group by part, f
), o as (
  select '' as filter_order union all select filter_order || x from o, unnest(['A', 'B', 'C', 'D', 'E']) as u(x) where not contains(filter_order, x)
), s as (
  select filter_order, step, [position(x in filter_order) for x in string_split('ABCDE', '')] as place from o, range(1, 6) as r(step) where length(filter_order) = 5
), k as (
  select part, filter_order, step, n, good, toxic, f[position(filter_order[step] in 'ABCDE')] as fails,
    len(list_filter(range(1, 6), lambda i: f[i] and place[i] < step)) > 0 as gone, len(list_filter(f, lambda x: x)) = 1 as alone from c, s
), r as (
  select part, filter_order, cast(step as int) as step, coalesce(sum(n) filter (where not gone and not fails), 0) as kept, coalesce(sum(n) filter (where not gone and fails), 0) as removed,
    coalesce(sum(n) filter (where gone and fails), 0) as redundant, coalesce(sum(n) filter (where fails and alone), 0) as unique_fails,
    coalesce(sum(good) filter (where not gone and fails), 0) as good_lost, coalesce(sum(toxic) filter (where not gone and fails), 0) as toxic_lost
  from k group by part, filter_order, step
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, filter_order[step]) as bigint) as shapley from r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_katz, op2_byte_bpe, op3_packing, op4_token_files, op5_language, op6_chat, op7_token_counts, op8_top_k, op9_quality, op10_near_dup, op11_alignment, op12_vector_dups, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op8_top_k": OP8_SQL, "op10_near_dup": OP10_SQL, "op12_vector_dups": OP12_SQL, "op13_filter_audit": OP13_SQL}
