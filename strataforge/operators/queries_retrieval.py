"""Queries of the rankers over all chunks and the SQL they are compared with. Queries: the cases whose pos is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_tokens, tokens
from ..plans.tables import spread, table
from . import index as I
from . import retrieval as R
from .best import best, dense_best


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks").select("pos", "language", "version", "document_id", "document_key", "document_title", "heading_path", "content"), "pos")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").where("pos % 100 = 0 and query is not null").select(F.col("pos").alias("query_id"), "query")


def _out(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "pos", "score")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return _out(R.best_hits(chunks, _queries(spark, d), 5, prefer_language="zh"))


def bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return _out(R.best_hits(chunks, _queries(spark, d), 5, scope=(F.col("language") == "en") & F.col("version").isin("v1.6.2", "v2.0.0")))


def bm25_fields_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return _out(R.best_hits(chunks, _queries(spark, d), 5, fields=True))


def bm25_source_diverse(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return _out(R.source_diverse(R.best_by_document(chunks, _queries(spark, d), 7), 2, 5))


def bm25_doc_cap(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return _out(R.capped_per_document(R.best_by_document(chunks, _queries(spark, d), 5), 1, 5))


def scoped_stats_bm25(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d).where("language = 'en'")
    return _out(R.best_hits(chunks, _queries(spark, d), 5, repeated=True, two=("body", 2)))


def token_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return _out(R.best_hits(chunks, _queries(spark, d), 5, plain=True))


def _two_rankings(spark: SparkSession, d: str, depth: int) -> DataFrame:
    chunks, queries = _chunks(spark, d), _queries(spark, d)
    a = R.best_ranked(chunks, queries, depth).withColumn("list_id", F.lit(0))
    b = R.best_ranked(chunks, queries, depth, fields=True).withColumn("list_id", F.lit(1))
    return a.unionByName(b)


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return R.fused(_two_rankings(spark, d, 50), 5)


def weighted_rrf(spark: SparkSession, d: str) -> DataFrame:
    return R.fused(_two_rankings(spark, d, 50), 5, weight=F.when(F.col("list_id") == 0, 0.7).otherwise(0.3))


def generic_rrf(spark: SparkSession, d: str) -> DataFrame:
    return R.fused(_two_rankings(spark, d, 20), 5, rrf_k=10)


def faceted_rrf(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases").where("pos % 100 = 0 and summary is not null")
    split = cases.select("pos", F.posexplode(R.facets(F.col("summary"))).alias("facet", "query")).withColumn("query_id", F.col("pos") * 8 + F.col("facet"))
    hits = R.best_ranked(_chunks(spark, d), split.select("query_id", "query"), 20)
    lists = hits.select(F.expr("query_id div 8").alias("query_id"), F.expr("query_id % 8").alias("list_id"), "pos", "rank")
    return R.fused(lists, 5)


def pool_rerank(spark: SparkSession, d: str) -> DataFrame:
    chunks, queries = _chunks(spark, d), _queries(spark, d)
    again = best(R.lexical(chunks, queries), R.FIELD_WEIGHTS, 5, pool=R.best_ranked(chunks, queries, 100))
    return _out(R.ranked(again, [F.desc("score"), F.asc("pos")], 5))


def _dense_and_bm25(spark: SparkSession, d: str, depth: int) -> DataFrame:
    chunks, queries = _chunks(spark, d), _queries(spark, d)
    dense = R.hashed_hits(chunks, queries, depth).withColumn("list_id", F.lit(0))
    lexical = R.best_ranked(chunks, queries, depth).withColumn("list_id", F.lit(1))
    return dense.unionByName(lexical)


def dense_hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """RRF of the hashed vectors (list 0) and BM25 (list 1)."""
    return R.fused(_dense_and_bm25(spark, d, 50), 5)


def dense_weighted_rrf(spark: SparkSession, d: str) -> DataFrame:
    return R.fused(_dense_and_bm25(spark, d, 50), 5, weight=F.when(F.col("list_id") == 0, 0.7).otherwise(0.3))


def dense_pool_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The best hundred of BM25, ordered anew by the hashed vectors."""
    chunks, queries = _chunks(spark, d), _queries(spark, d)
    scores = dense_best(chunks, queries, 5, pool=R.best_ranked(chunks, queries, 100))
    return _out(R.ranked(scores, [F.desc("score"), F.asc("pos")], 5))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, d, "embeddings")
    return vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("scope"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_hits(*_vectors(spark, d), 5)


def dense_scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_hits(*_vectors(spark, d), 5, same_scope=True)


def dense_two_level(spark: SparkSession, d: str) -> DataFrame:
    wide = R.dense_hits(*_vectors(spark, d), 20)
    return wide.where("rank <= 5 and score > 0")


def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dimension"), F.sqrt(R.dot("embedding", "embedding")).alias("norm"))
    return v.select("vec_id", "dimension", F.round("norm", 4).alias("norm"), (F.abs(F.col("norm") - 1) < 1e-3).alias("unit"))


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    found = I.postings(R.corpus_index(_chunks(spark, d)), "body")
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    stats = I.averages(R.corpus_index(_chunks(spark, d)), ["body"])
    return stats.select("n", F.round("avg_body", 6).alias("avg_length"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


def facet_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cases").where("summary is not null").select("pos", F.posexplode(R.facets(F.col("summary"))).alias("facet_id", "facet"))
    return rows.select("pos", "facet_id", "facet")


def query_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which of a query's first twelve distinct terms its five best hits contain."""
    chunks, queries = _chunks(spark, d), _queries(spark, d)
    wanted = queries.select("query_id", F.slice(F.array_distinct(tokens(F.col("query"))), 1, 12).alias("terms"))
    hits = best(R.lexical(chunks, queries), {"body": 1.0}, 5, pool=R.best_ranked(chunks, queries, 5), named=True)
    have = hits.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("have"))
    both = wanted.join(have, "query_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    n = F.size(F.array_intersect("terms", "have"))
    ratio = n / F.size("terms")
    return both.where(F.size("terms") > 0).select(
        "query_id", n.alias("matched"), F.size(F.array_except("terms", "have")).alias("missing"), F.round(ratio, 6).alias("ratio"),
        F.when(ratio >= 0.8, "strong").when(ratio > 0, "partial").otherwise("limited").alias("support"),
    )


def retrieval_signals(spark: SparkSession, d: str) -> DataFrame:
    """Score signals of the ten best hits of each query: top, margin, means, share of the most frequent document."""
    chunks = _chunks(spark, d)
    hits = R.best_hits(chunks, _queries(spark, d), 10)
    most = hits.groupBy("query_id", "document_id").agg(F.count("*").alias("k")).groupBy("query_id").agg(F.max("k").alias("k"))
    one = hits.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2"),
        F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("mean3"), F.avg("score").alias("mean_all"), F.count("*").alias("n"),
    )
    return one.join(most, "query_id").select(
        "query_id", "top1", F.round(F.col("top1") - F.col("top2"), 6).alias("margin"), F.round("mean3", 6).alias("mean3"),
        F.round("mean_all", 6).alias("mean_all"), F.round(F.col("k") / F.col("n"), 6).alias("dominant_ratio"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_scoped, bm25_fields_topk, bm25_source_diverse, bm25_doc_cap, scoped_stats_bm25, token_overlap_topk, hybrid_rrf, weighted_rrf, generic_rrf, faceted_rrf,
        pool_rerank, dense_hybrid_rrf, dense_weighted_rrf, dense_pool_rerank, dense_topk, dense_scoped_topk, dense_two_level, vector_checks, term_stats, corpus_summary, token_counts, facet_split, query_coverage, retrieval_signals,
    )
}

_TOKENS = sql_tokens("content")


def _bm25_sql(queries: str = "SELECT pos AS query_id, query FROM cases WHERE pos % 100 = 0 AND query IS NOT NULL", corpus: str = "chunks", weighted: bool = False, least: int = 1) -> str:
    return f"""qs AS ({queries}),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens('query')}) AS term FROM qs) GROUP BY 1, 2),
ct AS (SELECT pos, {_TOKENS} AS t FROM {corpus}),
st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM ct),
ps AS (SELECT pos, term, count(*) AS tf, any_value(l) AS l FROM (SELECT pos, len(t) AS l, unnest(t) AS term FROM ct) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM ps GROUP BY 1),
bm AS (SELECT query_id, pos, round(sum({'qtf *' if weighted else ''} ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score
  FROM qt JOIN df USING (term) JOIN ps USING (term), st GROUP BY 1, 2 HAVING count(*) >= {least})"""


_FIELDS = {"title": ("document_title", 3.0), "heading_path": ("array_to_string(heading_path, ' ')", 4.0), "body": ("content", 1.0)}
_FIELDS_SQL = (
    "ft AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS field, {w} AS w, pos, {sql_tokens(c)} AS t FROM chunks" for k, (c, w) in _FIELDS.items())
    + """),
fa AS (SELECT field, avg(len(t)) AS al, count(*) AS n FROM ft GROUP BY 1),
fp AS (SELECT field, w, pos, term, count(*) AS tf, any_value(l) AS l FROM (SELECT field, w, pos, len(t) AS l, unnest(t) AS term FROM ft) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3, 4),
fd AS (SELECT term, count(DISTINCT pos) AS df FROM fp GROUP BY 1),
bf AS (SELECT query_id, pos, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score
  FROM qt JOIN fd USING (term) JOIN fp USING (term) JOIN fa USING (field) GROUP BY 1, 2)"""
)


def _top(scores: str, k: int, order: str = "score DESC, pos", where: str = "true") -> str:
    return f"SELECT query_id, rank, pos, score FROM (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {scores} JOIN chunks USING (pos) WHERE score > 0 AND {where}) WHERE rank <= {k}"


def _rrf(lists: str, k: int = 5, rrf: int = 60, weight: str = "1.0") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, pos) AS rank FROM (SELECT query_id, pos, round(sum({weight} / ({rrf} + rank)), 9) AS rrf, array_to_string(list_sort(list(DISTINCT list_id::VARCHAR)), ',') AS lists FROM ({lists}) GROUP BY 1, 2)) WHERE rank <= {k}"


def _lists(depth: int) -> str:
    return " UNION ALL ".join(f"SELECT query_id, {i} AS list_id, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM {s}) WHERE rank <= {depth}" for i, s in enumerate(("bm", "bf")))


_DENSE = "SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q ON "
_DENSE_TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({})) WHERE rank <= 5"
_FACETS = """fc AS (SELECT pos, summary, list_filter(list_transform(regexp_split_to_array(summary, '[;；\\n]+'), lambda p: trim(regexp_replace(p, '^\\s*(?:[-*•]|\\d+[.)、])\\s*', ''))), lambda p: p <> '') AS p FROM cases WHERE summary IS NOT NULL),
fx AS (SELECT pos, CASE WHEN len(p) <= 1 THEN [summary] WHEN len(p) > 4 THEN list_concat(p[1:3], [array_to_string(p[4:], '；')]) ELSE p END AS f FROM fc),
fs AS (SELECT pos, generate_subscripts(f, 1) - 1 AS facet_id, unnest(f) AS facet FROM fx)"""

SQL = {
    "bm25_topk": f"WITH {_bm25_sql()} {_top('bm', 5, 'score DESC, (language IS NOT NULL AND language = ' + chr(39) + 'zh' + chr(39) + ') DESC, pos')}",
    "bm25_scoped": f"WITH {_bm25_sql()} {_top('bm', 5, where='language = ' + chr(39) + 'en' + chr(39) + ' AND version IN (' + chr(39) + 'v1.6.2' + chr(39) + ', ' + chr(39) + 'v2.0.0' + chr(39) + ')')}",
    "bm25_fields_topk": f"WITH {_bm25_sql()}, {_FIELDS_SQL} {_top('bf', 5)}",
    "bm25_source_diverse": f"""WITH {_bm25_sql()},
h AS (SELECT query_id, pos, score, document_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM bm JOIN chunks USING (pos) WHERE score > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY r) AS nth, min(r) OVER (PARTITION BY query_id, document_id) AS first_r FROM h)
SELECT query_id, rank, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN r <= 2 THEN 0 WHEN first_r > 2 AND nth = 1 THEN 1 ELSE 2 END, r) AS rank FROM g) WHERE rank <= 5""",
    "bm25_doc_cap": f"""WITH {_bm25_sql()},
h AS (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, pos) AS nth FROM bm JOIN chunks USING (pos) WHERE score > 0)
SELECT query_id, rank, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM h WHERE nth <= 1) WHERE rank <= 5""",
    "scoped_stats_bm25": f"WITH {_bm25_sql(corpus='(SELECT * FROM chunks WHERE language = ' + chr(39) + 'en' + chr(39) + ')', weighted=True, least=2)} {_top('bm', 5)}",
    "token_overlap_topk": f"WITH {_bm25_sql()}, ov AS (SELECT query_id, pos, count(*)::DOUBLE AS score FROM qt JOIN ps USING (term) GROUP BY 1, 2) {_top('ov', 5)}",
    "hybrid_rrf": f"WITH {_bm25_sql()}, {_FIELDS_SQL} {_rrf(_lists(50))}",
    "weighted_rrf": f"WITH {_bm25_sql()}, {_FIELDS_SQL} {_rrf(_lists(50), weight='CASE WHEN list_id = 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END')}",
    "generic_rrf": f"WITH {_bm25_sql()}, {_FIELDS_SQL} {_rrf(_lists(20), rrf=10)}",
    "faceted_rrf": f"""WITH {_FACETS}, {_bm25_sql('SELECT pos * 8 + facet_id AS query_id, facet AS query FROM fs WHERE pos % 100 = 0')}
{_rrf('SELECT query_id // 8 AS query_id, query_id % 8 AS list_id, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM bm) WHERE rank <= 20')}""",
    "pool_rerank": f"""WITH {_bm25_sql()}, {_FIELDS_SQL},
pool AS (SELECT query_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM bm) WHERE r <= 100)
SELECT query_id, rank, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM bf JOIN pool USING (query_id, pos)) WHERE rank <= 5""",
    "dense_topk": _DENSE_TOP.format(_DENSE + "true"),
    "dense_scoped_topk": _DENSE_TOP.format(_DENSE + "v.label = q.label"),
    "dense_two_level": "SELECT * FROM (" + _DENSE_TOP.format(_DENSE + "true") + ") WHERE score > 0",
    "vector_checks": "SELECT vec_id, len(embedding) AS dimension, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 1e-3 AS unit FROM embeddings",
    "term_stats": f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest({_TOKENS}) AS term FROM chunks) GROUP BY 1, 2) GROUP BY 1",
    "corpus_summary": f"SELECT count(*) AS n, round(avg(len({_TOKENS})), 6) AS avg_length FROM chunks",
    "token_counts": f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)",
    "facet_split": f"WITH {_FACETS} SELECT pos, facet_id, facet FROM fs",
    "query_coverage": f"""WITH {_bm25_sql()},
w AS (SELECT query_id, list_distinct({sql_tokens('query')}) AS d, {sql_tokens('query')} AS o FROM qs),
o AS (SELECT query_id, term, min(i) AS i FROM (SELECT query_id, unnest(o) AS term, generate_subscripts(o, 1) AS i FROM w) GROUP BY 1, 2),
f AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS r FROM o) WHERE r <= 12),
t5 AS (SELECT query_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM bm) WHERE r <= 5),
hv AS (SELECT DISTINCT query_id, term FROM t5 JOIN ps USING (pos)),
c AS (SELECT f.query_id, count(hv.term) AS matched, count(*) - count(hv.term) AS missing FROM f LEFT JOIN hv ON f.query_id = hv.query_id AND f.term = hv.term GROUP BY 1)
SELECT query_id, matched, missing, round(matched / (matched + missing), 6) AS ratio, CASE WHEN matched / (matched + missing) >= 0.8 THEN 'strong' WHEN matched > 0 THEN 'partial' ELSE 'limited' END AS support FROM c""",
    "retrieval_signals": f"""WITH {_bm25_sql()},
h AS (SELECT * FROM (SELECT query_id, score, document_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM bm JOIN chunks USING (pos) WHERE score > 0) WHERE rank <= 10),
m AS (SELECT query_id, max(k) AS k FROM (SELECT query_id, document_id, count(*) AS k FROM h GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT query_id, max(score) FILTER (rank = 1) AS top1, max(score) FILTER (rank = 2) AS top2, avg(score) FILTER (rank <= 3) AS mean3, avg(score) AS mean_all, count(*) AS n FROM h GROUP BY 1)
SELECT query_id, top1, round(top1 - top2, 6) AS margin, round(mean3, 6) AS mean3, round(mean_all, 6) AS mean_all, round(k / n, 6) AS dominant_ratio FROM a JOIN m USING (query_id)""",
}
