"""Queries of the evaluation metrics: the rankings of the stated case queries against their required sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from . import metrics as M
from . import retrieval as R
from .queries_lifecycle import ITEM_DIFF, item_diff
from .queries_retrieval import _FIELDS_SQL, _bm25_sql, _chunks, _queries


def _hits(spark: SparkSession, d: str, fields: bool = False, depth: int = 10) -> DataFrame:
    chunks = _chunks(spark, d)
    return R.best_hits(chunks, _queries(spark, d), depth, fields).select("query_id", "rank", F.col("document_id").alias("source"), "score")


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").where("pos % 100 = 0 and query is not null").select(F.col("pos").alias("query_id"), F.explode("required_sources").alias("source"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select(F.col("pos").alias("query_id"), F.coalesce("category", F.lit("-")).alias("category"), F.coalesce("language", F.lit("-")).alias("language"))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.summary(M.per_query(_hits(spark, d), _truth(spark, d)))


def eval_by_category(spark: SparkSession, d: str) -> DataFrame:
    rows = M.per_query(_hits(spark, d), _truth(spark, d)).join(_facts(spark, d), "query_id")
    return M.summary(rows, ["category", "language"])


def eval_conventions(spark: SparkSession, d: str) -> DataFrame:
    """The three gains and two reciprocal ranks of each query side by side."""
    hits, truth = _hits(spark, d), _truth(spark, d)
    out = M.per_query(hits, truth).select("query_id", F.round("rr", 6).alias("rr_first"), F.round("ndcg", 6).alias("ndcg_once"))
    out = out.join(M.per_query(hits, truth, mrr="sum", ndcg="distinct").select("query_id", F.round("rr", 6).alias("rr_sum"), F.round("ndcg", 6).alias("ndcg_distinct")), "query_id")
    return out.join(M.per_query(hits, truth, ndcg="chunk").select("query_id", F.round("ndcg", 6).alias("ndcg_chunk")), "query_id")


def eval_at_ks(spark: SparkSession, d: str) -> DataFrame:
    hits, truth = _hits(spark, d), _truth(spark, d).distinct()
    wanted = truth.groupBy("query_id").agg(F.count("*").alias("wanted"))
    first = hits.join(truth, ["query_id", "source"]).groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    ks = F.explode(F.array(*(F.lit(k) for k in (1, 3, 5, 10)))).alias("k")
    grid = wanted.select("query_id", "wanted", ks).join(first, "query_id", "left").groupBy("query_id", "wanted", "k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("found"))
    return grid.groupBy("k").agg(F.round(F.avg(F.col("found") / F.col("wanted")), 6).alias("recall"), F.round(F.avg((F.col("found") == F.col("wanted")).cast("int")), 6).alias("complete"), F.sum("found").alias("found"))


def policy_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Both rankers' metrics in one table, the winner by (hit at 1, mrr, hit at k, name) marked."""
    both = M.summary(M.per_query(_hits(spark, d), _truth(spark, d))).withColumn("policy", F.lit("bm25"))
    both = both.unionByName(M.summary(M.per_query(_hits(spark, d, fields=True), _truth(spark, d))).withColumn("policy", F.lit("bm25_fields")))
    best = both.agg(F.max_by("policy", F.struct("hit_at_1", "mrr", "hit_at_k", "policy")).alias("best"))
    return both.crossJoin(F.broadcast(best)).select("policy", "hit_at_1", "hit_at_k", "mrr", "ndcg", (F.col("policy") == F.col("best")).alias("winner"))  # one row


def no_answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Best scores of answerable and unanswerable cases: least, upper median, nearest-rank p95, greatest."""
    top = _hits(spark, d, depth=1)
    cases = table(spark, d, "cases").where("pos % 100 = 0 and query is not null").select(F.col("pos").alias("query_id"), "answerable")
    rows = cases.join(top, "query_id", "left").select("answerable", F.coalesce("score", F.lit(0.0)).alias("score"))
    w = F.sort_array(F.collect_list("score"))
    return rows.groupBy("answerable").agg(
        F.count("*").alias("n"), F.min("score").alias("least"), F.element_at(w, (F.count("*") / 2).cast("int") + 1).alias("median_upper"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY score)").alias("p95"), F.max("score").alias("greatest"),
    )


def failure_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Incomplete cases grouped by each of four dimensions, unpivoted in one pass."""
    cases = table(spark, d, "cases").select(F.col("pos").alias("query_id"), "category", "suite", "language", "change_type")
    rows = M.per_query(_hits(spark, d), _truth(spark, d)).where("complete = 0").join(cases, "query_id")
    long = rows.select("query_id", "wanted", "found", F.expr("stack(4, 'category', category, 'suite', suite, 'language', language, 'change_type', change_type) as (dimension, value)"))
    return long.where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("cases"), F.sum(F.col("wanted") - F.col("found")).alias("missing"), F.min("query_id").alias("first_case"))


def marker_recall(spark: SparkSession, d: str) -> DataFrame:
    """Per query: identifiers of the query as markers, and how many a chunk of its required sources contains."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("[a-z]+\\.[a-z]+(?:_[a-z]+)*"), F.lit(0)))
    markers = table(spark, d, "cases").where("pos % 100 = 0 and query is not null").select(F.col("pos").alias("query_id"), F.explode(found("query")).alias("marker"))
    texts = table(spark, d, "chunks").where("content is not null").select(F.col("document_id").alias("source"), F.explode(found("content")).alias("marker")).distinct()
    there = _truth(spark, d).distinct().join(texts, "source").select("query_id", "marker").distinct().withColumn("there", F.lit(1))
    return markers.join(there, ["query_id", "marker"], "left").groupBy("query_id").agg(F.count("*").alias("markers"), F.count("there").alias("found"), F.round(F.count("there") / F.count("*"), 6).alias("recall"))


def recorded_change_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Recorded changes against those the snapshots give, by recorded and actual class; the step to a snapshot is from the one before it that exists."""
    actual = item_diff(spark, d).select("project_id", F.col("to").alias("to_no"), "identifier", F.col("change_type").alias("actual"))
    said = table(spark, d, "item_changes").select("project_id", F.expr("try_cast(regexp_extract(new_version_id, 's([0-9]+)$', 1) as int)").alias("to_no"), F.lower(F.trim("external_identifier")).alias("identifier"), F.col("change_type").alias("recorded")).distinct()
    both = said.where("to_no is not null").join(actual, ["project_id", "to_no", "identifier"], "left")
    return both.groupBy("recorded", F.coalesce("actual", F.lit("NONE")).alias("actual")).agg(F.count("*").alias("n"))


def family_precision(spark: SparkSession, d: str) -> DataFrame:
    """Derived cases as predictions of their parent's family: precision and recall; an empty denominator counts as 1."""
    one = table(spark, d, "cases").groupBy("case_id").agg(F.max("derived_from").alias("parent"), F.max(F.translate(F.lower(F.trim("family_id")), "- ", "__")).alias("family"))
    parents = one.select(F.col("case_id").alias("parent"), F.col("family").alias("parent_family"))
    said = one.where("parent is not null").join(parents, "parent")
    right = F.count_if(F.col("family") == F.col("parent_family"))
    return said.agg(F.count("*").alias("links"), right.alias("same_family"), F.round(F.when(F.count("*") == 0, 1.0).otherwise(right / F.count("*")), 6).alias("precision"))


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.sample_stats(table(spark, d, "events"), ["event_type"], "value")


def percent_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of each event type against the overall mean, with a label of the effect."""
    rows = table(spark, d, "events")
    base, own = rows.agg(F.avg("value").alias("base")), rows.groupBy("event_type").agg(F.avg("value").alias("mean"))
    change = (F.col("base") - F.col("mean")) / F.col("base") * 100
    return own.crossJoin(F.broadcast(base)).select("event_type", F.round(change, 3).alias("reduction"), F.when(change > 0, "improved").when(change < 0, "regressed").otherwise("unchanged").alias("effect"))  # one row


QUERIES = {
    f.__name__: f
    for f in (
        eval_summary, eval_by_category, eval_conventions, eval_at_ks, policy_comparison, no_answer_scores, failure_grouping, marker_recall, recorded_change_accuracy, family_precision, latency_stats, percent_reduction,
    )
}


def _per_query(hits: str, name: str = "m", k: int = 5, mrr: str = "first", ndcg: str = "source_once") -> str:
    rows = hits
    pre = ""
    if ndcg == "distinct":
        pre = f"{name}f AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM {hits} GROUP BY 1, 2), "
        rows = f"{name}f"
    gain = "sum(ag)" if ndcg == "chunk" else "sum(1.0 / log2(rank + 1.0))"
    rr = "coalesce(1.0 / first, 0.0)" if mrr == "first" else "coalesce(inverse / wanted, 0.0)"
    return f"""{pre}{name}s AS (SELECT query_id, source, min(rank) AS rank, sum(1.0 / log2(rank + 1.0)) AS ag FROM {rows} JOIN tr USING (query_id, source) WHERE rank <= {k} GROUP BY 1, 2),
{name}q AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(1.0 / rank) AS inverse, {gain} AS dcg FROM {name}s GROUP BY 1),
{name} AS (SELECT query_id, wanted, coalesce((first = 1)::INT, 0) AS hit_at_1, CASE WHEN found > 0 THEN 1 ELSE 0 END AS hit_at_k, coalesce(found, 0) / wanted AS recall, CASE WHEN found = wanted THEN 1 ELSE 0 END AS complete,
  coalesce(found, 0) AS found, {rr} AS rr, coalesce(dcg, 0.0) / list_sum(list_transform(range(1, least(wanted, {k}) + 1), lambda i: 1.0 / log2(i + 1.0))) AS ndcg FROM wn LEFT JOIN {name}q USING (query_id))"""


_TRUTH = "tr AS (SELECT DISTINCT pos AS query_id, unnest(required_sources) AS source FROM cases WHERE pos % 100 = 0 AND query IS NOT NULL), wn AS (SELECT query_id, count(*) AS wanted FROM tr GROUP BY 1)"


def _hits_sql(name: str, scores: str, depth: int = 10) -> str:
    return f"{name} AS (SELECT query_id, rank, document_id AS source, score FROM (SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM {scores} JOIN chunks USING (pos) WHERE score > 0) WHERE rank <= {depth})"


_SUMMARY = "count(*) AS queries, round(avg(hit_at_1), 6) AS hit_at_1, round(avg(hit_at_k), 6) AS hit_at_k, round(avg(recall), 6) AS macro_recall, round(sum(found) / sum(wanted), 6) AS micro_recall, round(avg(complete), 6) AS complete, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg"
_BASE = f"WITH {_bm25_sql()}, {_TRUTH}, {_hits_sql('h', 'bm')}"
_MARK = "list_distinct(regexp_extract_all({}, '[a-z]+\\.[a-z]+(?:_[a-z]+)*'))"
_S = "sha256(trim(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g')))"

SQL = {
    "eval_summary": f"{_BASE}, {_per_query('h')} SELECT {_SUMMARY} FROM m",
    "eval_by_category": f"{_BASE}, {_per_query('h')} SELECT category, language, {_SUMMARY} FROM (SELECT m.*, coalesce(category, '-') AS category, coalesce(language, '-') AS language FROM m JOIN cases ON pos = query_id) GROUP BY GROUPING SETS ((), (category), (language))",
    "eval_conventions": f"{_BASE}, {_per_query('h', 'ma')}, {_per_query('h', 'mb', mrr='sum', ndcg='distinct')}, {_per_query('h', 'mc', ndcg='chunk')} SELECT ma.query_id, round(ma.rr, 6) AS rr_first, round(ma.ndcg, 6) AS ndcg_once, round(mb.rr, 6) AS rr_sum, round(mb.ndcg, 6) AS ndcg_distinct, round(mc.ndcg, 6) AS ndcg_chunk FROM ma JOIN mb USING (query_id) JOIN mc USING (query_id)",
    "eval_at_ks": f"""{_BASE}, f AS (SELECT query_id, source, min(rank) AS rank FROM h JOIN tr USING (query_id, source) GROUP BY 1, 2),
g AS (SELECT wn.query_id, wanted, k, count(*) FILTER (rank <= k) AS found FROM wn CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) LEFT JOIN f ON f.query_id = wn.query_id GROUP BY 1, 2, 3)
SELECT k, round(avg(found / wanted), 6) AS recall, round(avg((found = wanted)::INT), 6) AS complete, sum(found)::BIGINT AS found FROM g GROUP BY 1""",
    "policy_comparison": f"""WITH {_bm25_sql()}, {_FIELDS_SQL}, {_TRUTH}, {_hits_sql('h', 'bm')}, {_hits_sql('hf', 'bf')}, {_per_query('h', 'ma')}, {_per_query('hf', 'mb')},
u AS (SELECT 'bm25' AS policy, {_SUMMARY} FROM ma UNION ALL SELECT 'bm25_fields', {_SUMMARY} FROM mb)
SELECT policy, hit_at_1, hit_at_k, mrr, ndcg, policy = (SELECT policy FROM u ORDER BY hit_at_1 DESC, mrr DESC, hit_at_k DESC, policy DESC LIMIT 1) AS winner FROM u""",
    "no_answer_scores": f"""WITH {_bm25_sql()}, {_hits_sql('h', 'bm', 1)}, r AS (SELECT answerable, coalesce(score, 0.0) AS score FROM cases LEFT JOIN h ON h.query_id = pos WHERE pos % 100 = 0 AND query IS NOT NULL)
SELECT answerable, count(*) AS n, min(score) AS least, list_sort(list(score))[count(*) // 2 + 1] AS median_upper, quantile_disc(score, 0.95) AS p95, max(score) AS greatest FROM r GROUP BY 1""",
    "failure_grouping": f"""{_BASE}, {_per_query('h')}, r AS (SELECT m.*, category, suite, language, change_type FROM m JOIN cases ON pos = query_id WHERE complete = 0),
l AS ({' UNION ALL '.join(f"SELECT query_id, wanted, found, '{c}' AS dimension, {c} AS value FROM r" for c in ('category', 'suite', 'language', 'change_type'))})
SELECT dimension, value, count(*) AS cases, sum(wanted - found)::BIGINT AS missing, min(query_id) AS first_case FROM l WHERE value IS NOT NULL GROUP BY 1, 2""",
    "marker_recall": f"""WITH {_TRUTH}, k AS (SELECT pos AS query_id, unnest({_MARK.format('query')}) AS marker FROM cases WHERE pos % 100 = 0 AND query IS NOT NULL),
x AS (SELECT DISTINCT document_id AS source, unnest({_MARK.format('content')}) AS marker FROM chunks WHERE content IS NOT NULL), t AS (SELECT DISTINCT query_id, marker, 1 AS there FROM tr JOIN x USING (source))
SELECT query_id, count(*) AS markers, count(there) AS found, round(count(there) / count(*), 6) AS recall FROM k LEFT JOIN t USING (query_id, marker) GROUP BY 1""",
    "recorded_change_accuracy": f"""WITH {ITEM_DIFF},
c AS (SELECT DISTINCT project_id, try_cast(regexp_extract(new_version_id, 's([0-9]+)$', 1) AS INT) AS to_no, lower(trim(external_identifier)) AS identifier, change_type AS recorded FROM item_changes)
SELECT recorded, coalesce(df.change_type, 'NONE') AS actual, count(*) AS n FROM c LEFT JOIN df ON c.project_id = df.project_id AND c.to_no = df."to" AND c.identifier = df.identifier WHERE to_no IS NOT NULL GROUP BY 1, 2""",
    "family_precision": """WITH o AS (SELECT case_id, max(derived_from) AS parent, max(translate(lower(trim(family_id)), '- ', '__')) AS family FROM cases GROUP BY 1)
SELECT count(*) AS links, count(*) FILTER (a.family = b.family) AS same_family, round(CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (a.family = b.family) / count(*) END, 6) AS precision FROM o a JOIN o b ON a.parent = b.case_id""",
    "latency_stats": "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, quantile_disc(value, 0.95) AS p95_nearest, min(value) AS least, max(value) AS greatest, round(stddev_pop(value), 4) AS deviation FROM events GROUP BY 1",
    "percent_reduction": "WITH b AS (SELECT avg(value) AS base FROM events), o AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1) SELECT event_type, round((base - mean) / base * 100, 3) AS reduction, CASE WHEN base > mean THEN 'improved' WHEN base < mean THEN 'regressed' ELSE 'unchanged' END AS effect FROM o, b",
}
