"""One query per operator, with production parameters over its whole table, and its statement where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import statements
from gridspark.llm.common import read
from gridspark.llm.exact_dedup import exact_dedup
from gridspark.llm.html import extract_pages
from gridspark.llm.licenses import BLOCK as BLOCK_GAP, LEAST, PARAGRAPH, SIGNAL, TEMPLATES, scan
from gridspark.llm.packing import pack_documents
from gridspark.llm.prefix_trie import BLOCK, HEADS, prefix_trie
from gridspark.llm.pu_quality import quality_scores
from gridspark.llm.quality import quality
from gridspark.llm.resampling import BUCKETS, LEAST_WORDS, PERCENT, SEED, resample
from gridspark.llm.sentencepieces import encode_and_decode
from gridspark.llm.simhash import near_dedup
from gridspark.llm.substrings import substring_dedup
from gridspark.llm.token_counts import length_histogram, token_lengths
from gridspark.llm.warc import audit, leaves_by, manifest, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept"]
    return quality(read(spark, sf_dir, "documents")).select(*columns)


@query(
    "op8_exact_dedup",
    r"""
    with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
    select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
    from t window g as (partition by text_sha256)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


@query(
    "op2_warc_fixity",
    r"""
    with p as (
        select page_id, row_number() over (order by page_id) - 1 as pos,
               'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
               || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
               || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' as head,
               chr(13) || chr(10) || chr(13) || chr(10) as gap, coalesce(html, '') as html,
               case when page_id % 97 = 13 then replace(coalesce(html, ''), 'e', 'f') when page_id % 193 = 50 then left(coalesce(html, ''), 100) else coalesce(html, '') end as other
        from pages
    ), q as (
        select *, strlen(head) + strlen(strlen(html)::varchar) + strlen(html) + 8 as length,
               strlen(head) + strlen(strlen(other)::varchar) + strlen(other) + 8 as other_length
        from p
    ), r as (select *, coalesce(sum(length) over (order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from q)
    select page_id, pos, "offset", length, case when page_id % 389 = 7 then null else other_length end as found_length,
           case when page_id % 389 = 7 then 'missing' else 'altered' end as fault
    from r where page_id % 389 = 7 or html <> other
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second replica with planted faults (bytes changed, cut short, lost) against the archive of all pages."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    html, page = F.coalesce("html", F.lit("")), F.col("page_id")
    faulty = F.when(page % 97 == 13, F.regexp_replace(html, "e", "f")).when(page % 193 == 50, F.left(html, F.lit(100))).otherwise(html)
    found = records(pages)
    second = records(pages.withColumn("html", faulty)).where(~(F.coalesce(page % 389, F.lit(0)) == 7))
    ours = manifest(found)
    return audit(ours, leaves_by(second, ours))


def repository_path(doc_id: Column, source: Column, lang: Column) -> Column:
    """Documents as files of repositories: a source, a language and two levels of numbered folders; every fiftieth is a licence file."""
    number = lambda size: F.floor(doc_id / size).cast("string")
    name = F.when(doc_id % 50 == 0, F.concat(F.lit("LICENSE."), doc_id.cast("string"))).otherwise(F.concat(doc_id.cast("string"), F.lit(".txt")))
    return F.concat_ws("/", source, lang, F.concat(F.lit("d"), number(5000)), F.concat(F.lit("d"), number(500)), name)


LICENSE_SQL = rf"""
    with files as (
        select doc_id, concat_ws('/', source, lang, 'd' || (doc_id // 5000), 'd' || (doc_id // 500),
               case when doc_id % 50 = 0 then 'LICENSE.' || doc_id else doc_id || '.txt' end) as path, text
        from documents
    ), parts as (
        select doc_id, unnest(string_split(text, chr(10))) as part from files
        union select doc_id, unnest(regexp_split_to_array(text, '{PARAGRAPH}')) from files
        union select doc_id, unnest(regexp_split_to_array(text, '{BLOCK_GAP}')) from files
        union select doc_id, text from files where doc_id % 50 = 0
    ), each as (
        select distinct doc_id, array_to_string(regexp_extract_all(lower(part), '[a-z0-9]+'), ' ') as notice
        from parts where regexp_matches(part, '{SIGNAL}')
    ), counted as (select notice, count(*) as n from each where notice <> '' group by 1),
    term as (select notice, n, term, count(*) as tf from (select notice, n, unnest(string_split(notice, ' ')) as term from counted) group by all),
    total as (select sum(n) as total from counted),
    df as (select term, sum(n) as df from term group by 1),
    weighed as (select notice, term, (1 + ln(tf)) * (1 + ln((1 + total) / (1 + df))) as w from term join df using (term), total),
    norm as (select notice, sqrt(sum(w * w)) as norm from weighed group by 1),
    template(license, number, line) as (values {", ".join("('%s', %d, '%s')" % (k, i, x.replace("'", "''")) for k, v in TEMPLATES.items() for i, x in enumerate(v))}),
    tterm as (select license, number, term, count(*) as tf from (select license, number, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) as term from template) group by all),
    vector as (select license, number, term, (1 + ln(tf)) * (1 + ln((1 + total) / (1 + coalesce(df, 0)))) as t from tterm left join df using (term), total),
    length as (select license, number, sqrt(sum(t * t)) as length from vector group by all),
    cosine as (
        select notice, license, number, round(sum(w * t / length) / any_value(norm), 6) as similarity
        from weighed join vector using (term) join length using (license, number) join norm using (notice) group by notice, license, number
    ), scored as (
        select notice, license, similarity from cosine where similarity >= {LEAST}
        qualify row_number() over (partition by notice order by similarity desc, license) = 1
    ), own as (
        select doc_id, license, similarity from each join scored using (notice)
        qualify row_number() over (partition by doc_id order by similarity desc, license) = 1
    ), owned as (
        select doc_id, path, license as own, similarity, regexp_replace(path, '/?[^/]*$', '') as folder from files left join own using (doc_id)
    ), licensed as (
        select folder as above, own as inherited from owned where own is not null and doc_id % 50 = 0
        qualify row_number() over (partition by folder order by similarity desc, own) = 1
    ), nearest as (
        select doc_id, inherited from owned join licensed on folder = above or starts_with(folder, above || '/') where own is null
        qualify row_number() over (partition by doc_id order by length(above) desc) = 1
    )
    select doc_id, path, coalesce(own, inherited) as license, round(similarity, 4) as similarity,
           case when own is not null then 'header' when inherited is not null then 'directory' end as origin
    from owned left join nearest using (doc_id)
"""


@query("op5_license_scan", LICENSE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    files = docs.select("doc_id", repository_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("path"), "text")
    return scan(files).withColumn("similarity", F.round("similarity", 4))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return length_histogram(token_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


@query("op11_importance_resampling", statements.resampling(BUCKETS, LEAST_WORDS, PERCENT, SEED))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_prefix_trie", statements.prefix_trie(BLOCK, HEADS))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


@query("op13_quality_classifier")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
