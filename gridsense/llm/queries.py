"""The registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense.llm import alignment, divergence, extraction, lattice, licenses, minhash, mixing, packing, quality, secrets, shards, token_files, urls
from gridsense.llm.base import table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.matches(table(spark, folder, "documents"), licenses.PHRASES + licenses.TEMPLATES)
    return licenses.report(found).withColumnRenamed("key", "doc_id")


def op2_embedding_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, folder, "embeddings")).withColumnRenamed("key", "vec_id")


#: Target shares of tokens.
MIXTURE = {
    "source": {"src0": 0.30, **{f"src{i}": 0.70 / 19 for i in range(1, 20)}},
    "lang": {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13},
    "topic": {"prose": 0.94, "table": 0.02, "markup": 0.02, "shouting": 0.02},
}
MIXTURE_KEPT = 0.85


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = mixing.with_topic(table(spark, folder, "documents"))
    found = mixing.mixed(docs, MIXTURE, MIXTURE_KEPT)
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")


#: Fixed values of the query.
URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filtered(table(spark, folder, "pages"), URL_RULES).withColumnRenamed("key", "page_id")


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, folder, "documents"))).withColumnRenamed("key", "doc_id")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_digests(table(spark, folder, "documents"), BYTE_VOCABULARY).withColumnRenamed("key", "doc_id")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = shards.sharded(table(spark, folder, "documents"), shards.SHARDS)
    return rows.drop("number").withColumnRenamed("key", "doc_id")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.withColumnRenamed("key", "doc_id")


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents")).drop("root", "check").withColumnRenamed("key", "doc_id")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), WORD_VOCABULARY).withColumnRenamed("key", "doc_id")


def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages")).withColumnRenamed("key", "page_id")


def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), BYTE_VOCABULARY, PIECE_MODEL).withColumnRenamed("key", "doc_id")


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_embedding_near_duplicates, op3_mixing, op4_url_filter, op5_secret_scan, op6_token_files, op7_sharding, op8_quality_rules, op9_near_duplicates, op10_packing, op11_html_extraction, op12_tokenizer_alignment, op13_source_divergence)}

#: Operator 13 in plain SQL: every term of every document.
DIVERGENCE_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), terms AS (
    SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
    SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS held
    FROM (SELECT DISTINCT lang, source FROM docs)
    LEFT JOIN sizes USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source) USING (lang, source)
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.held + g.v)::HUGEINT AS p
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
    SELECT lang, term, 1 + (1000000000 * (sum(n) + 1)::HUGEINT) // (any_value(h) + any_value(v))::HUGEINT AS q
    FROM counts JOIN (SELECT lang, sum(held) AS h, any_value(v) AS v FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term
), found AS (
    SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(f, 0)::BIGINT AS value
    FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
    LEFT JOIN (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f
        FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
    ) s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""

SQL: dict[str, str] = {"op13_source_divergence": DIVERGENCE_SQL}
