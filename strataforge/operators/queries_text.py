"""Queries of the scalar text functions and document parsing, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import content_hash, sql_squeeze, tokens
from ..plans.tables import table
from ..sources.files import heading_chunks, image_references

CLASSES = {"model_replacement": ["model", "registry", "模型"], "parameter_config": ["threshold", "set", "设为", "默认值"], "deployment": ["release", "version", "版本", "升级"]}


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("pos", content_hash(F.col("content")).alias("hash"))


def content_classes(spark: SparkSession, d: str) -> DataFrame:
    """How many rows and documents share each content."""
    rows = table(spark, d, "chunks").where("content is not null").select("document_key", content_hash(F.col("content")).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("rows"), F.countDistinct("document_key").alias("documents"))


def document_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.document_title(F.col("text"), F.coalesce("document_key", F.lit("-"))).alias("title"))


def clause_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = rules.clauses(F.col("summary"))
    return table(spark, d, "cases").where("summary is not null").select("pos", F.size(parts).alias("clauses"), F.element_at(parts, 1).alias("first_clause"))


def change_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cases").select("pos", rules.keyword_class(F.col("summary"), CLASSES).alias("change_class"))
    return rows.groupBy("change_class").agg(F.count("*").alias("cases"), F.min("pos").alias("first_case"))


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select(rules.canonical_url(F.concat(F.regexp_replace("source_url", "^https", "HTTPS"), F.lit("/?b=2&a=1#top"))).alias("url")).groupBy("url").agg(F.count("*").alias("rows"))


def redacted_texts(spark: SparkSession, d: str) -> DataFrame:
    text = rules.redacted(F.concat(F.lit("password: x"), F.col("case_id"), F.lit(" then token="), F.col("case_id"), F.lit("; "), F.coalesce("query", F.lit(""))))
    return table(spark, d, "cases").select("pos", text.alias("text"))


def value_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.value_summary(F.col("text")).alias("s")).select("doc_id", "s.type", "s.length", "s.sha256")


def token_costs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("document_id").agg(F.sum(rules.token_cost(F.coalesce("content", F.lit("")))).alias("cost"))


def extractive_drafts(spark: SparkSession, d: str) -> DataFrame:
    return rules.extractive_draft(table(spark, d, "chunks"), "document_id", "pos", F.col("content"))


def exact_token_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("language", tokens(F.col("content")).alias("t"))
    return rows.groupBy("language").agg(F.count("*").alias("chunks"), F.sum(F.size(F.coalesce("t", F.array().cast("array<string>")))).alias("tokens"))


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The hashed vector of every chunk's content."""
    return table(spark, d, "chunks").where("content is not null").select("pos", rules.hashed_vectors("content").alias("vector"))


def document_sections(spark: SparkSession, d: str) -> DataFrame:
    return heading_chunks(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def images_in_documents(spark: SparkSession, d: str) -> DataFrame:
    return image_references(table(spark, d, "documents").select("doc_id", F.concat(F.col("text"), F.lit("\n![figure](img/a.png)")).alias("text")), "doc_id", "text").groupBy("target").agg(F.count("*").alias("references"), F.count("heading").alias("under_heading"))


QUERIES = {
    f.__name__: f
    for f in (
        content_hashes, content_classes, document_titles, clause_counts, change_classes, canonical_urls, redacted_texts, value_summaries, token_costs, extractive_drafts, exact_token_stats, hashed_vectors,
        document_sections, images_in_documents,
    )
}


def _sql_term(term: str) -> str:
    return f"regexp_matches(t, '(^|[^a-z0-9_]){term}([^a-z0-9_]|$)')::INT" if term.isascii() else f"contains(t, '{term}')::INT"


_HASH = f"sha256({sql_squeeze('content')})"
_CLAUSES = "list_filter(list_transform(regexp_split_to_array(regexp_replace(summary, '([a-z])\\.\\s+', '\\1;', 'g'), '[;；\\n。]+'), lambda p: trim(p)), lambda p: p <> '')"
SQL = {
    "content_hashes": f"SELECT pos, {_HASH} AS hash FROM chunks",
    "content_classes": f"SELECT {_HASH} AS hash, count(*) AS rows, count(DISTINCT document_key) AS documents FROM chunks WHERE content IS NOT NULL GROUP BY 1",
    "document_titles": "SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?m)^#\\s+(.+?)\\s*$', 1), ''), document_key, '-') AS title FROM documents",
    "clause_counts": f"SELECT pos, least(len(p), 3) AS clauses, p[1] AS first_clause FROM (SELECT pos, {_CLAUSES} AS p FROM cases WHERE summary IS NOT NULL)",
    "change_classes": "WITH k AS (SELECT pos, lower(coalesce(summary, '')) AS t FROM cases), s AS (SELECT pos, "
    + ", ".join(f"{' + '.join(map(_sql_term, terms))} AS {name}" for name, terms in CLASSES.items())
    + " FROM k) SELECT CASE WHEN greatest("
    + ", ".join(CLASSES)
    + ") = 0 THEN 'general' "
    + " ".join(f"WHEN {n} = greatest({', '.join(CLASSES)}) THEN '{n}'" for n in CLASSES)
    + " END AS change_class, count(*) AS cases, min(pos) AS first_case FROM s GROUP BY 1",
    "canonical_urls": "SELECT CASE WHEN source_url IS NOT NULL THEN lower(regexp_extract(source_url, '^([a-z]+://[^/]+)', 1)) || regexp_extract(source_url, '^[a-z]+://[^/]+(/.*)$', 1) || '?a=1&b=2' END AS url, count(*) AS rows FROM sources GROUP BY 1",
    "redacted_texts": "SELECT pos, 'password: [REDACTED] then token=[REDACTED]; ' || coalesce(query, '') AS text FROM cases",
    "value_summaries": "SELECT doc_id, 'text' AS type, length(text) AS length, sha256(text) AS sha256 FROM documents",
    "token_costs": "SELECT document_id, sum(greatest(1, length(coalesce(content, '')) // 3))::BIGINT AS cost FROM chunks GROUP BY 1",
    "extractive_drafts": f"""WITH r AS (SELECT document_id, min(pos) AS p, {sql_squeeze('content')} AS t FROM chunks WHERE content IS NOT NULL GROUP BY 1, 3 HAVING {sql_squeeze('content')} <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY p) AS n FROM r) SELECT document_id, string_agg(t, '；' ORDER BY n) AS draft FROM n WHERE n <= 3 GROUP BY 1""",
    "images_in_documents": "SELECT 'img/a.png' AS target, count(*) AS references, count(*) FILTER (regexp_matches(text, '(?m)^#{1,6}\\s+')) AS under_heading FROM documents WHERE text IS NOT NULL",
}
