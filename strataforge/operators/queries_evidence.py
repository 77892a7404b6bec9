"""Queries of evidence selection, registries and version ingest, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checked import path_overlap
from ..functions.rules import stable_id, token_cost
from ..functions.text import content_hash
from ..plans.tables import table
from . import evidence as E
from . import lifecycle as L
from . import metrics as M
from . import retrieval as R
from .queries_lifecycle import ITEM_ROWS, _HASH, _PIECES, _SRC, _pieces, _sources
from .queries_metrics import _SUMMARY, _TRUTH, _facts, _hits, _hits_sql, _per_query, _truth
from .queries_retrieval import _FACETS, _FIELDS_SQL, _bm25_sql, _chunks, _queries

_IDENTIFIER = "[a-z]+\\.[a-z]+(?:_[a-z]+)*"


def citation_membership(spark: SparkSession, d: str) -> DataFrame:
    return E.cited_membership(_truth(spark, d), _hits(spark, d), ["query_id", "source"])


def required_first(spark: SparkSession, d: str) -> DataFrame:
    """Three hits of each query's ten, those of required sources first."""
    hits = _hits(spark, d).join(_truth(spark, d).distinct().withColumn("required", F.lit(True)), ["query_id", "source"], "left").withColumn("required", F.coalesce("required", F.lit(False)))
    kept = R.ranked(hits.withColumnRenamed("rank", "old_rank"), [F.desc("required"), F.asc("old_rank")], 3)
    return kept.select("query_id", "rank", "old_rank", "required")


def language_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether a query's ten best hits hold each language of the corpus that is asked for."""
    chunks = _chunks(spark, d)
    hits = R.best_hits(chunks, _queries(spark, d), 10)
    return hits.groupBy("query_id").agg(F.count_if(F.col("language") == "zh").alias("zh"), F.count_if(F.col("language") == "en").alias("en")).withColumn("covered", (F.col("zh") > 0) & (F.col("en") > 0))


def request_evidence(spark: SparkSession, d: str) -> DataFrame:
    """At most eight hits for each case summary, its clauses being the queries."""
    cases = table(spark, d, "cases").where("pos % 100 = 0 and summary is not null")
    split = cases.select("pos", F.posexplode(R.facets(F.col("summary"))).alias("facet", "query")).withColumn("query_id", F.col("pos") * 8 + F.col("facet"))
    chunks = _chunks(spark, d)
    hits = R.best_hits(chunks, split.select("query_id", "query"), 5)
    places = table(spark, d, "chunks").select("pos", "document_key", "heading")
    rows = hits.select("query_id", "rank", "pos").join(places, "pos").join(split.select("query_id", "query"), "query_id")
    rows = rows.select(
        F.expr("query_id div 8").alias("request"), F.expr("query_id % 8").alias("facet"), "rank", "pos", F.coalesce("document_key", F.col("pos").cast("string")).alias("document"),
        path_overlap(F.col("query"), F.col("document_key"), F.col("heading")).alias("overlap"),
    )
    return E.by_request(rows, "request", ["facet", "rank"], lambda r: E.select_evidence(r, 8), "request bigint, facet bigint, pos bigint, document string, place int")


def expanded_context(spark: SparkSession, d: str) -> DataFrame:
    """The five best hits of each query, each with its section's first chunk and neighbours, within 800 tokens."""
    chunks = _chunks(spark, d)
    hits = R.best_hits(chunks, _queries(spark, d), 5).select("query_id", "rank", "pos")
    costs = table(spark, d, "chunks").select("pos", token_cost(F.coalesce("content", F.lit(""))).alias("cost"))
    rows = table(spark, d, "chunks").select("document_id", "heading", "pos")
    # The section's first chunk, its anchor, comes before the neighbours.
    first = rows.groupBy("document_id", "heading").agg(F.min("pos").alias("to"))
    anchors = rows.join(first, rows["document_id"].eqNullSafe(first["document_id"]) & rows["heading"].eqNullSafe(first["heading"])).select(F.col("pos").alias("from"), "to", F.lit(0).alias("distance"))
    near = L.neighbours(rows, ["document_id", "heading"], "pos", 1).select("from", "to", "distance").union(anchors)
    own = near.join(hits.select(F.col("pos").alias("from")).distinct(), "from", "left_semi").join(costs.withColumnRenamed("pos", "to"), "to")
    order = F.struct(F.abs("distance").alias("far"), "distance", "to", "cost")
    around = own.groupBy(F.col("from").alias("pos")).agg(F.array_sort(F.collect_list(order)).alias("around"))
    rows = hits.join(costs, "pos").join(around, "pos", "left").select("query_id", "rank", "pos", "cost", F.to_json("around").alias("around"))

    def choose(group: list[dict]) -> list[dict]:
        import json

        near_by = {r["pos"]: [{"query_id": r["query_id"], "pos": x["to"], "cost": x["cost"]} for x in json.loads(r["around"] or "[]")] for r in group}
        return E.expand_context(group, near_by, 800)

    return E.by_request(rows, "query_id", ["rank"], choose, "query_id bigint, pos bigint, cost bigint, place int")


def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(E.facet_matches(F.col("heading_path"), "Examples")).groupBy("version").agg(F.count("*").alias("chunks"))


def allowed_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").groupBy(E.path_allowed(F.col("document_path"), ["docs/guides", "docs/notes"]).alias("allowed")).agg(F.count("*").alias("rows"))


def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "chunks").select("document_id").distinct().withColumn("_have", F.lit(1))
    rows = table(spark, d, "sources").withColumn("document_id", F.concat_ws(":", "version", "language", "document_key")).join(have, "document_id", "left")
    reason = F.when(F.col("license").isNull(), "no license").when(F.col("publisher").isNull(), "no publisher").when(F.col("_have").isNull(), "no chunks").otherwise("included")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("rows"), F.countDistinct("document_key").alias("documents"))


def version_ingest_report(spark: SparkSession, d: str) -> DataFrame:
    """What ingesting each document's newest version does: classes of its sections and contents whose vectors are reused or new."""
    rows = _pieces(spark, d).select("document_key", "version", F.expr("try_cast(regexp_extract(chunk_id, ':([0-9]+)$', 1) as bigint)").alias("number"), F.split("chunk_id", ":")[1].alias("lang"), content_hash(F.col("content")).alias("hash"))
    versions = rows.select("document_key", "version").distinct()
    top = versions.groupBy("document_key").agg(F.max("version").alias("newest"))
    before = versions.join(top, "document_key").where("version < newest").groupBy("document_key").agg(F.max("version").alias("previous"))
    tagged = rows.join(top, "document_key").join(before, "document_key")
    keys = ["document_key", "lang", "number"]
    diff = L.keyed_diff(tagged.where("version = previous").groupBy(*keys).agg(F.max("hash").alias("hash")), tagged.where("version = newest").groupBy(*keys).agg(F.max("hash").alias("hash")), keys, "hash")
    known = tagged.where("version <= previous").select("document_key", F.col("hash").alias("new_value")).distinct().withColumn("_known", F.lit(1))
    new = diff.where("change_type <> 'REMOVED'").select("document_key", "new_value").distinct().join(known, ["document_key", "new_value"], "left")
    reuse = new.where("new_value is not null").groupBy("document_key").agg(F.count("_known").alias("reused"), (F.count("*") - F.count("_known")).alias("embedded"))
    return L.diff_summary(diff, ["document_key"]).join(reuse, "document_key", "left").na.fill(0, ["reused", "embedded"])


def version_status(spark: SparkSession, d: str) -> DataFrame:
    rows = _sources(spark, d).select("document_key", "version").distinct()
    active = rows.groupBy("document_key").agg(F.max("version").alias("active"))
    w = R.Window.partitionBy("document_key").orderBy("version")
    return rows.join(active, "document_key").select("document_key", "version", F.when(F.col("version") == F.col("active"), "ACTIVE").otherwise("SUPERSEDED").alias("status"), F.lag("version").over(w).alias("previous_version"))


def policy_gate(spark: SparkSession, d: str) -> DataFrame:
    """The fielded ranker against the plain one by category: differences and whether it may replace it."""
    facts = _facts(spark, d)
    base, cand = (M.summary(M.per_query(_hits(spark, d, fields=f), _truth(spark, d)).join(facts, "query_id"), ["category"]).na.fill("*", ["category"]) for f in (False, True))
    both = base.alias("b").join(cand.alias("c"), "category")
    deltas = {k: F.round(F.col(f"c.{k}") - F.col(f"b.{k}"), 6) for k in ("hit_at_k", "macro_recall", "mrr", "ndcg")}
    passed = F.lit(True)
    for v in deltas.values():
        passed = passed & (v >= 0)
    return both.select("category", *(v.alias(f"d_{k}") for k, v in deltas.items()), passed.alias("passed"))


def case_set_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rule breaks of the case set, by rule."""
    cases = table(spark, d, "cases")
    query = F.lower(F.trim("query"))
    rules = {
        "repeated case id": L.duplicate_keys(cases, ["case_id"]).select("case_id"),
        "query in train and evaluation": cases.where("query is not null").groupBy(query.alias("q")).agg(F.max(F.lower(F.trim("split")) == "train").alias("t"), F.max(F.lower(F.trim("split")) != "train").alias("e"), F.min("case_id").alias("case_id")).where("t and e").select("case_id"),
        "answerable without sources": cases.where("answerable and (required_sources is null or size(required_sources) = 0)").select("case_id"),
        "parent is no case": cases.where("derived_from is not null").join(cases.select(F.col("case_id").alias("derived_from")).distinct(), "derived_from", "left_anti").select("case_id"),
    }
    out = None
    for rule, rows in rules.items():
        part = rows.select(F.lit(rule).alias("rule"), "case_id")
        out = part if out is None else out.union(part)
    return out.groupBy("rule").agg(F.count("*").alias("breaks"), F.min("case_id").alias("first_case"))


def carried_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of every snapshot that has an earlier one, from the one before it."""
    rows = table(spark, d, "engineering_snapshots").select("project_id", "snapshot_no", F.lower(F.trim("external_identifier")).alias("identifier"), "title", content_hash(F.col("content")).alias("hash"), "delivered_at", "item_id")
    rows = L.latest(rows.where("identifier is not null"), ["project_id", "snapshot_no", "identifier"], [F.desc("delivered_at"), F.desc("hash"), F.desc("item_id")])
    keys = ["project_id", "from", "to", "identifier"]
    old, new = L.stepped(rows, ["project_id"], "snapshot_no")
    old = old.select(*keys, "hash", F.col("title").alias("old_title"))
    return new.join(old, [*keys, "hash"], "left").select(*keys, F.coalesce("title", "old_title").alias("title"), (F.col("title").isNull() & F.col("old_title").isNotNull()).alias("carried"))


def location_join(spark: SparkSession, d: str) -> DataFrame:
    """Items with others at the same location (project, version, document, section), counted without pairing them."""
    rows = table(spark, d, "engineering_snapshots").select("project_id", "version_id", "document_id", "section_id", F.lower(F.trim("external_identifier")).alias("identifier")).distinct()
    own = rows.groupBy("project_id", "version_id", "document_id", "section_id").agg(F.count("*").alias("items"))
    return own.where("items > 1").groupBy("project_id").agg(F.sum("items").alias("items"), F.sum(F.col("items") * (F.col("items") - 1)).alias("links"))


def adjacent_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("document_id", F.expr("try_cast(regexp_extract(chunk_id, ':([0-9]+)$', 1) as bigint)").alias("number")).distinct()
    w = R.Window.partitionBy("document_id").orderBy("number")
    return rows.withColumn("before", F.lag("number").over(w)).groupBy("document_id").agg(F.count("*").alias("numbers"), F.count_if(F.col("number") - F.col("before") == 1).alias("adjacent"))


def engineering_items(spark: SparkSession, d: str) -> DataFrame:
    """One item for each (document, identifier) named in its chunks, with a stable id."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col("content"), F.lit(_IDENTIFIER), F.lit(0))))
    rows = table(spark, d, "chunks").where("content is not null").select("document_key", found.alias("identifier")).distinct()
    return rows.select("document_key", "identifier", stable_id("item_", F.col("document_key"), F.col("identifier")).alias("item_id"))


def identifier_positions(spark: SparkSession, d: str) -> DataFrame:
    return E.identifier_spans(table(spark, d, "chunks"), "pos", "content", _IDENTIFIER).withColumnRenamed("id", "pos")


def embedded_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages through the embedding slot, with a toy encoder, and the generation slot without a generator."""
    embed, answer = E.embedder(lambda texts: [[len(t), t.count(" ")] for t in texts], 2), E.generator(None)
    return table(spark, d, "eval_passages").select("item_id", F.element_at(embed("passage"), 1).cast("bigint").alias("chars"), answer("passage").alias("answer"))


QUERIES = {
    f.__name__: f
    for f in (
        citation_membership, required_first, language_coverage, request_evidence, expanded_context, facet_filter, allowed_paths, exclusion_reasons, version_ingest_report, version_status, policy_gate, case_set_checks,
        carried_titles, location_join, adjacent_chunks, engineering_items, identifier_positions, embedded_passages,
    )
}

_BASE = f"WITH {_bm25_sql()}, {_TRUTH}, {_hits_sql('h', 'bm')}"
_DELTAS = ("hit_at_k", "macro_recall", "mrr", "ndcg")
SQL = {
    "citation_membership": f"{_BASE} SELECT query_id, count(*) AS cited, count(t) AS valid, count(*) = count(t) AS all_valid FROM tr LEFT JOIN (SELECT DISTINCT query_id, source, 1 AS t FROM h) USING (query_id, source) GROUP BY 1",
    "required_first": f"""{_BASE}, r AS (SELECT h.query_id, h.rank AS old_rank, tr.source IS NOT NULL AS required FROM h LEFT JOIN tr ON tr.query_id = h.query_id AND tr.source = h.source)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY required DESC, old_rank) AS rank, old_rank, required FROM r) WHERE rank <= 3""",
    "language_coverage": f"""WITH {_bm25_sql()}, h AS (SELECT * FROM (SELECT query_id, language, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM bm JOIN chunks USING (pos) WHERE score > 0) WHERE rank <= 10)
SELECT query_id, count(*) FILTER (language = 'zh') AS zh, count(*) FILTER (language = 'en') AS en, count(*) FILTER (language = 'zh') > 0 AND count(*) FILTER (language = 'en') > 0 AS covered FROM h GROUP BY 1""",
    "facet_filter": "SELECT version, count(*) AS chunks FROM chunks WHERE list_contains(heading_path, 'Examples') OR list_contains(heading_path, '*') GROUP BY 1",
    "allowed_paths": "SELECT coalesce(document_path IN ('docs/guides', 'docs/notes') OR starts_with(document_path, 'docs/guides/') OR starts_with(document_path, 'docs/notes/'), false) AS allowed, count(*) AS rows FROM sources GROUP BY 1",
    "exclusion_reasons": "SELECT CASE WHEN license IS NULL THEN 'no license' WHEN publisher IS NULL THEN 'no publisher' WHEN concat_ws(':', version, language, document_key) NOT IN (SELECT document_id FROM chunks WHERE document_id IS NOT NULL) THEN 'no chunks' ELSE 'included' END AS reason, count(*) AS rows, count(DISTINCT document_key) AS documents FROM sources GROUP BY 1",
    "version_ingest_report": f"""WITH {_PIECES}, r AS (SELECT document_key, version, try_cast(regexp_extract(chunk_id, ':([0-9]+)$', 1) AS BIGINT) AS number, split_part(chunk_id, ':', 2) AS lang, {_HASH} AS hash FROM pc),
t AS (SELECT document_key, max(version) AS newest FROM r GROUP BY 1), b AS (SELECT document_key, max(version) AS previous FROM r JOIN t USING (document_key) WHERE version < newest GROUP BY 1),
g AS (SELECT r.*, newest, previous FROM r JOIN t USING (document_key) JOIN b USING (document_key)),
o AS (SELECT document_key, lang, number, max(hash) AS hash FROM g WHERE version = previous GROUP BY 1, 2, 3), n AS (SELECT document_key, lang, number, max(hash) AS hash FROM g WHERE version = newest GROUP BY 1, 2, 3),
d AS (SELECT coalesce(o.document_key, n.document_key) AS document_key, n.hash AS nh, CASE WHEN o.document_key IS NULL THEN 'ADDED' WHEN n.document_key IS NULL THEN 'REMOVED' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'UNCHANGED' ELSE 'MODIFIED' END AS k
  FROM o FULL JOIN n ON o.document_key = n.document_key AND o.lang = n.lang AND o.number = n.number),
s AS (SELECT document_key, count(*) FILTER (k = 'ADDED') AS added, count(*) FILTER (k = 'REMOVED') AS removed, count(*) FILTER (k = 'MODIFIED') AS modified, count(*) FILTER (k = 'UNCHANGED') AS unchanged, count(*) AS total FROM d GROUP BY 1),
w AS (SELECT DISTINCT document_key, nh FROM d WHERE k <> 'REMOVED' AND nh IS NOT NULL), e AS (SELECT DISTINCT document_key, hash AS nh, 1 AS known FROM g WHERE version <= previous),
u AS (SELECT document_key, count(known) AS reused, count(*) - count(known) AS embedded FROM w LEFT JOIN e USING (document_key, nh) GROUP BY 1)
SELECT s.*, coalesce(reused, 0) AS reused, coalesce(embedded, 0) AS embedded FROM s LEFT JOIN u USING (document_key)""",
    "version_status": f"WITH {_SRC}, v AS (SELECT DISTINCT document_key, version FROM sr) SELECT document_key, version, CASE WHEN version = max(version) OVER (PARTITION BY document_key) THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, lag(version) OVER (PARTITION BY document_key ORDER BY version) AS previous_version FROM v",
    "policy_gate": f"""WITH {_bm25_sql()}, {_FIELDS_SQL}, {_TRUTH}, {_hits_sql('h', 'bm')}, {_hits_sql('hf', 'bf')}, {_per_query('h', 'ma')}, {_per_query('hf', 'mb')},
x AS (SELECT coalesce(category, '*') AS category, {_SUMMARY} FROM (SELECT ma.*, coalesce(category, '-') AS category FROM ma JOIN cases ON pos = query_id) GROUP BY GROUPING SETS ((), (category))),
y AS (SELECT coalesce(category, '*') AS category, {_SUMMARY} FROM (SELECT mb.*, coalesce(category, '-') AS category FROM mb JOIN cases ON pos = query_id) GROUP BY GROUPING SETS ((), (category)))
SELECT category, {', '.join(f'round(y.{k} - x.{k}, 6) AS d_{k}' for k in _DELTAS)}, {' AND '.join(f'round(y.{k} - x.{k}, 6) >= 0' for k in _DELTAS)} AS passed FROM x JOIN y USING (category)""",
    "case_set_checks": """SELECT rule, count(*) AS breaks, min(case_id) AS first_case FROM (SELECT 'repeated case id' AS rule, case_id FROM cases GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'query in train and evaluation', min(case_id) FROM cases WHERE query IS NOT NULL GROUP BY lower(trim(query)) HAVING bool_or(lower(trim(split)) = 'train') AND bool_or(lower(trim(split)) <> 'train')
UNION ALL SELECT 'answerable without sources', case_id FROM cases WHERE answerable AND (required_sources IS NULL OR len(required_sources) = 0)
UNION ALL SELECT 'parent is no case', case_id FROM cases WHERE derived_from IS NOT NULL AND derived_from NOT IN (SELECT case_id FROM cases)) GROUP BY 1""",
    "carried_titles": f"""WITH {ITEM_ROWS} SELECT n.project_id, n.f AS "from", n.t AS "to", n.identifier, coalesce(n.title, o.title) AS title, n.title IS NULL AND o.title IS NOT NULL AS carried
FROM n LEFT JOIN o ON n.project_id = o.project_id AND n.f = o.f AND n.t = o.t AND n.identifier = o.identifier AND n.hash = o.hash""",
    "location_join": """WITH l AS (SELECT project_id, version_id, document_id, section_id, count(*) AS items FROM (SELECT DISTINCT project_id, version_id, document_id, section_id, lower(trim(external_identifier)) AS i FROM engineering_snapshots) GROUP BY 1, 2, 3, 4)
SELECT project_id, sum(items)::BIGINT AS items, sum(items * (items - 1))::BIGINT AS links FROM l WHERE items > 1 GROUP BY 1""",
    "adjacent_chunks": "WITH n AS (SELECT DISTINCT document_id, try_cast(regexp_extract(chunk_id, ':([0-9]+)$', 1) AS BIGINT) AS number FROM chunks), l AS (SELECT *, lag(number) OVER (PARTITION BY document_id ORDER BY number) AS b FROM n) SELECT document_id, count(*) AS numbers, count(*) FILTER (number - b = 1) AS adjacent FROM l GROUP BY 1",
    "engineering_items": f"WITH n AS (SELECT DISTINCT document_key, unnest(regexp_extract_all(content, '{_IDENTIFIER}')) AS identifier FROM chunks WHERE content IS NOT NULL) SELECT document_key, identifier, 'item_' || substr(sha256('[\"' || document_key || '\",\"' || identifier || '\"]'), 1, 20) AS item_id FROM n",
    "embedded_passages": "SELECT item_id, length(passage) AS chars, 'GENERATION_NOT_CONFIGURED' AS answer FROM eval_passages",
}
