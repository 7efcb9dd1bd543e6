"""The subpackage's queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skysurvey.llm.bpe_codec import encode_decode
from skysurvey.llm.common import table
from skysurvey.llm.fingerprint import fingerprints
from skysurvey.llm.html_extract import extract_pages
from skysurvey.llm.langid import language_id
from skysurvey.llm.license_scan import license_scan
from skysurvey.llm.media import media_columns
from skysurvey.llm.ngram_join import ngram_join
from skysurvey.llm.packing import pack_documents
from skysurvey.llm.suffix_dedup import suffix_dedup
from skysurvey.llm.token_count import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), limit=512)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op5_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_html_extraction": op2_html_extraction,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_syncmer_fingerprints": op5_syncmer_fingerprints,
    "op6_mixture_packing": op6_mixture_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_media_columns": op9_media_columns,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), g AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                                           ELSE [array_to_string(words[i : i + 4], ' ') for i in range(1, len(words) - 3)] END) AS gram FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), o AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), e AS (
            SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
        ), f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
        ), r(a, b) AS (SELECT a, b FROM f UNION SELECT r.a, f.b FROM r JOIN f ON r.b = f.a)
        SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, least(documents.doc_id, coalesce((SELECT min(r.b) FROM r WHERE r.a = documents.doc_id), documents.doc_id)) AS component_id,
               (SELECT count(*) FROM f WHERE f.a = documents.doc_id) AS n_links
        FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id
    """,
    "op7_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), w AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d WHERE len(h) >= 200) AS q
        ), r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS rn FROM w) AS q WHERE rn > 1
        ), c AS (SELECT doc_id, p, sum(j) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, CASE WHEN p <= 100 + lag(p) OVER (PARTITION BY doc_id ORDER BY p) THEN 0 ELSE 1 END AS j FROM r) AS q
        ), s AS (SELECT doc_id, min(p) AS low, max(p) + 100 AS high FROM c GROUP BY doc_id, k
        ), t AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS past FROM s
        ), m AS (
            SELECT t.doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * past + 1, 2 * (low - past)), '' ORDER BY low) AS kept, max(high) AS last FROM t JOIN d ON d.doc_id = t.doc_id GROUP BY t.doc_id
        )
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(CASE WHEN m.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN m ON m.doc_id = d.doc_id
    """,
}
