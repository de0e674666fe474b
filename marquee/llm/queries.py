"""The operators as queries over the driver tables, with SQL oracles where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import alignment, centroid_clusters, chat, decontaminate, exact_dedup, language_id, line_chunks, minhash, packing, pieces, token_counts, url_filter, warc_fixity
from marquee.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: whether it leaks a benchmark item, which ones, and where."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), short_items=True)
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"),
                        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"), "leaks")


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as archives against a replica in which one record in 101 has a wrong byte and one in 211 is lost."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    wrong = F.when(F.col("page_id") % 101 == 7, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    index = warc_fixity.archive_index(warc_fixity.page_records(pages))
    replica = warc_fixity.archive_index(warc_fixity.page_records(pages.withColumn("html", wrong))).filter("place % 211 <> 3")
    return warc_fixity.audit(index, replica)


OP2_SQL = r"""
with pages_of as (select page_id, url, html, case when page_id % 101 = 7 then '~' || substr(html, 2) else html end as other from pages),
built as (
    select page_id, page_id // 1000 as archive,
           'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
           || 'WARC-Payload-Digest: sha256:' as head, html, other from pages_of),
records as (
    select page_id, archive,
           head || sha256(html) || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
           || chr(13) || chr(10) || chr(13) || chr(10) as a,
           head || sha256(other) || chr(13) || chr(10) || 'Content-Length: ' || strlen(other) || chr(13) || chr(10) || chr(13) || chr(10) || other
           || chr(13) || chr(10) || chr(13) || chr(10) as b from built),
placed as (
    select page_id, archive, strlen(a) as length, sha256(a) as digest_a, sha256(b) as digest_b,
           cast(coalesce(sum(strlen(a)) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as begins
    from records)
select archive, begins as "offset", length as length_a, case when page_id % 211 = 3 then null else length end as length_b, digest_a,
       case when page_id % 211 = 3 then null else digest_b end as digest_b,
       case when page_id % 211 = 3 then 'missing' else 'changed' end as status
from placed where page_id % 211 = 3 or digest_a <> digest_b"""


def op3_fuse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
groups as (select t, min(doc_id) as keep_id, count(*) as group_size from texts group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from texts join groups using (t)"""


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=True)


def op5_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", *[F.array_join(c, ",").alias(c) for c in ("strict_terms", "soft_terms")])


def _terms_sql(terms: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{t}'" for t in sorted(terms))
    return rf"list_filter([{listed}], lambda t: regexp_matches(low, concat('(^|[^\p{{L}}\p{{N}}])', t, '($|[^\p{{L}}\p{{N}}])')))"


OP5_SQL = rf"""
with cut as (
    select page_id, lower(coalesce(url, '')) as low,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
judged as (
    select page_id, host, path, {_terms_sql(url_filter.STRICT)} as strict_terms, {_terms_sql(url_filter.SOFT)} as soft_terms,
           case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from cut)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when len(strict_terms) >= 1 or len(soft_terms) >= {url_filter.SOFT_HITS} then 'block' else 'allow' end as verdict,
       array_to_string(strict_terms, ',') as strict_terms, array_to_string(soft_terms, ',') as soft_terms
from judged"""


def op6_segmentation_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), PIECES)


def op7_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_two_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_event_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (-1) whose texts hold control strings, from a log with edits, regenerations and messages taken back."""
    tricky = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return chat.read_back(chat.format_turns(turns, slips=True))


def _escaped_sql(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROL:
        sql = f"replace({sql}, '{control}', '{control[0]}\\{control[1:]}')"
    return sql


OP10_SQL = f"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, i, case i when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(i))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum({len(chat.START + chat.MESSAGE + chat.END)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")})) as bigint) as formatted_chars
from turns group by conv_id"""


def op11_identity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op12_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_heap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))


def _clusters_sql(rounds: int = centroid_clusters.ROUNDS) -> str:
    """Plain rounds: every vector against every centroid, by the same fixed values."""
    k, dimension = centroid_clusters.CLUSTERS, centroid_clusters.DIMENSION
    parts = [f"""kept as materialized (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda v: cast(floor({centroid_clusters.SCALE} * cast(v as double)) as bigint)) as x
    from embeddings where len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = {dimension} and len(embedding) = {dimension}),
c0 as materialized (select row_number() over (order by sha256('{centroid_clusters.SEED}:' || vec_id)) - 1 as j, x from kept
    qualify row_number() over (order by sha256('{centroid_clusters.SEED}:' || vec_id)) <= {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} as materialized (
    select r, min({k} * d + j) // {k} as d, min({k} * d + j) % {k} as j from (
        select r, j, cast(list_sum(list_transform(list_zip(kept.x, c{n}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from kept cross join c{n})
    group by r)""")
        if n < rounds:
            parts.append(f"""m{n} as (
    select j, i, cast((s - ((s % n) + n) % n) / n as bigint) as v from (
        select j, i, cast(sum(v) as bigint) as s, count(*) as n
        from (select a{n}.j, unnest(x) as v, unnest(range({dimension})) as i from a{n} join kept using (r)) group by j, i)),
c{n + 1} as materialized (select c{n}.j, coalesce(m.x, c{n}.x) as x from c{n} left join (select j, list(v order by i) as x from m{n} group by j) m on m.j = c{n}.j)""")
    return f"""with {", ".join(parts)}
select vec_id, cast(j as integer) as cluster, d as distance, cast(sum(d) over (partition by j) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
       sha256(array_to_string(c{rounds}.x, ',')) as centroid_sha256
from a{rounds} join kept using (r) join c{rounds} using (j)"""


def importable(query: Query) -> Query:
    """The query with this checkout on the import path of the Python workers, wherever the driver was started."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
        if here not in environment.get("PYTHONPATH", "").split(os.pathsep):
            environment["PYTHONPATH"] = os.pathsep.join(filter(None, (here, environment.get("PYTHONPATH", ""))))
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: importable(f) for f in (op1_string_tiling, op2_merkle_fixity, op3_fuse_filter, op4_line_chunks, op5_url_vocabulary, op6_segmentation_unigrams,
                                   op7_concatenate_and_cut, op8_circulant_minhash, op9_two_tier_counts, op10_event_chats,
                                   op11_identity_alignment, op12_distinct_chunks, op13_heap_bounds)}
QUERIES["pipeline"] = importable(corpus_pipeline.run)
ORACLES = {"op2_merkle_fixity": OP2_SQL, "op3_fuse_filter": OP3_SQL, "op5_url_vocabulary": OP5_SQL, "op10_event_chats": OP10_SQL,
           "op13_heap_bounds": _clusters_sql()}
