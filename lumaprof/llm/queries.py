"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaprof.llm import ann, bpe, chat, clustering, negatives, packing, pii, quality, sharding, simhash, token_shards, topk, warc
from lumaprof.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


@query("op1_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op4_bpe")
def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_simhash")
def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_sharding")
def _sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


@query("op10_pii")
def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(table(spark, sf_dir, "documents"))


@query("op3_quality")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op7_topk", sql="""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from pairs qualify rank <= 10
""")
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


@query("op8_ann")
def _ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


@query("op5_token_shards")
def _token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_shards.ordered(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op9_warc", sql="""
with kept as (
  select page_id, coalesce(page_id::varchar, '') as page, coalesce(url, '') as url, coalesce(html, '') as html from pages),
twins as (
  select *, sha256(page || chr(10) || strlen(url) || chr(10) || url || html) as record_id,
    case when ((page_id % 97) + 97) % 97 = 5 then left(html, greatest(length(html), 1) - 1) || '~' else html end as found_html,
    coalesce(((page_id % 89) + 89) % 89 = 7, false) as lost from kept),
headed as (
  select *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:sha256:' || record_id || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'X-Page-Id: ' || page || chr(13) || chr(10) || 'Content-Length: ' as head,
    chr(13) || chr(10) || chr(13) || chr(10) as blank from twins),
whole as (
  select record_id, page_id, lost, head || strlen(html) || blank || html || blank as a, head || strlen(found_html) || blank || found_html || blank as b from headed),
leaves as (
  select record_id, min(page_id) as page_id, sum(strlen(a))::bigint as bytes, count(*) as copies, count(*) filter (not lost) as found_copies,
    min(sha256(a)) as expected, min(sha256(b)) filter (not lost) as found from whole group by record_id),
cut as (select count(*) as digits from range(1, 16) as r(i), (select count(*) as n from leaves) where 256 * 16::double ** (i - 1) < n),
files as (select *, 'a' || left(record_id, digits::bigint) as archive from leaves, cut)
select record_id, archive, page_id, "offset", bytes, copies, found_copies, expected, found
from (select *, coalesce(sum(bytes) over (partition by archive order by record_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from files)
where copies <> found_copies or expected is distinct from found
""")
def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audited(table(spark, sf_dir, "pages"))


def _clustering_sql(k: int, rounds: int) -> str:
    """Assignments and means in turn, as one chain of tables."""
    steps = ["""v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0)""", f"""c0 as materialized (
  select (row_number() over (order by sha256('2:' || vec_id) nulls last, v) - 1)::int as cluster, v as c from v qualify cluster < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} as materialized (
  select vec_id, v, cluster, distance from (
    select *, (list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c))::bigint as distance
    from (select row_number() over () as row, * from v) cross join c{n})
  qualify row_number() over (partition by row order by distance, cluster) = 1)""")
        if n < rounds:
            steps.append(f"""m{n} as materialized (
  select cluster, list(m order by i) as c from (
    select cluster, i, floor(sum(v[i]) / count(*)) as m from a{n}, unnest(range(1, 65)) as u(i) group by cluster, i) group by cluster),
c{n + 1} as materialized (select cluster, coalesce(m{n}.c, c{n}.c) as c from c{n} left join m{n} using (cluster))""")
    return f"""with {",\n".join(steps)}
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::bigint::varchar), ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)"""


@query("op11_clustering", sql=_clustering_sql(40, 5))
def _clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.summarised(table(spark, sf_dir, "embeddings"))


@query("op12_chat", sql="""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
control as (select unnest(['<|im_start|>', '<|im_sep|>', '<|im_end|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>']) as c),
placed as (
  select *, lag(role) over w as before, row_number() over w as position, count(*) over (partition by conv_id) as turns from said
  window w as (partition by conv_id order by turn nulls first, role)),
sized as (
  select *, (select sum(length(s) + (length(s) - length(replace(s, chr(92), ''))) + 2 * marks)
    from (select s, (select sum((length(s) - length(replace(s, c, ''))) // length(c)) from control) as marks
      from (select unnest([role, text]) as s))) as chars
  from placed)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by position)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by position) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(32 + chars))::bigint as formatted_chars,
  bool_and(case role when 'system' then before is null when 'user' then before is null or before in ('system', 'assistant')
    when 'assistant' then coalesce(before = 'user', false) else false end
    and (position < turns or role in ('user', 'assistant'))) as valid
from sized group by conv_id
""")
def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(said.unionByName(planted))


@query("op13_hard_negatives", sql="""
with v as (
  select vec_id, case when ((vec_id % 7) + 7) % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scores as (
  select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same, list_inner_product(a.v, r.v)::bigint as score
  from v a join v r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
pairs as (
  select p.*, n.vec_id as negative_id, n.score as negative_score from positives p
  join scores n on n.anchor_id = p.anchor_id and not n.same and 80 * positive_score <= 100 * n.score and n.score <= positive_score)
select anchor_id, positive_id,
  cast(row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) as int) as rank,
  negative_id, positive_score, negative_score
from pairs qualify rank <= 5
""")
def _hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.usable(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select("vec_id", label.alias("label"), F.transform("x", lambda c: F.floor(c * 256).cast("double")).alias("v"))
    return negatives.mined(whole, F.col("vec_id") % 100 == 0)
