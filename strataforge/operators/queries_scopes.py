"""Queries of scopes, figures, decoded JSON and safe texts, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checked as C
from ..functions.rules import CLASS_CLAUSE, keyword_class, url_identity
from ..functions.text import content_hash, sql_squeeze, sql_tokens
from ..plans.tables import table
from . import evidence as E
from . import index as I
from . import metrics as M
from . import retrieval as R
from . import scopes as S
from .queries_metrics import _hits, _hits_sql, _truth
from .queries_retrieval import _FACETS, _bm25_sql, _chunks, _queries
from .queries_text import CLASSES

_COMPOSITES = {"first_series": ["v1.4.0", "v1.5.0", "v1.6.2"]}


def _versions(spark: SparkSession, d: str) -> set[str]:
    # One row for each release of the corpus.
    return {r[0] for r in table(spark, d, "sources").where("version is not null").select("version").distinct().collect()}


def version_scopes(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks each kind of version scope holds."""
    chunks, known, out = table(spark, d, "chunks").select("version"), _versions(spark, d), None
    for name in ("current", "all", "first_series", "v2.0.0"):
        composites = {k: [v for v in own if v in known] for k, own in _COMPOSITES.items()}
        part = S.in_versions(chunks, S.version_members(name, known, max(known), composites)).agg(F.count("*").alias("chunks")).select(F.lit(name).alias("scope"), "chunks")
        out = part if out is None else out.union(part)
    return out


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, version_id, project_id, document_type, status): one row for each document and version; the greatest version of a document and language is active."""
    rows = table(spark, d, "sources").where("version is not null and language is not null and document_key is not null")
    own = rows.groupBy("document_key", "language", "version").agg(F.max("repository").alias("project_id"), F.max("source_type").alias("document_type"))
    newest = own.groupBy("document_key", "language").agg(F.max("version").alias("newest"))
    own = own.join(newest, ["document_key", "language"])
    return own.select(
        F.concat_ws(":", "version", "language", "document_key").alias("document_id"), F.col("version").alias("version_id"), "project_id", "document_type",
        F.when(F.col("version") == F.col("newest"), "ACTIVE").otherwise("SUPERSEDED").alias("status"),
    )


def catalog_scope(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of active versions of Markdown documents of one project."""
    scope = S.Scope(project_ids=("lanternworks/edge-kit",), document_types=("markdown",))
    return S.catalog_scope(table(spark, d, "chunks").select("pos", "document_id"), _catalog(spark, d), scope).select("pos")


def catalog_history_scope(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of two named versions, active or not."""
    scope = S.Scope(version_ids=("v1.5.0", "v2.0.0"), active_only=False)
    return S.catalog_scope(table(spark, d, "chunks").select("pos", "document_id"), _catalog(spark, d), scope).select("pos")


def item_scope(spark: SparkSession, d: str) -> DataFrame:
    """Item rows of one organization and one kind of document."""
    rows, scope = table(spark, d, "engineering_snapshots"), S.Scope(organization_ids=("org_amber",), document_ids=("requirements",))
    return rows.where(scope.allows(organization_ids=F.col("organization_id"), document_ids=F.col("document_id"))).select("snapshot_no", "project_id", "item_id", "delivered_at")


def evidence_scope(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a version or of the newest version of their key."""
    rows = table(spark, d, "documents").select("doc_id", "document_key", F.col("version").alias("version_id"))
    newest = rows.groupBy("document_key").agg(F.max("version_id").alias("newest"))
    rows = rows.join(newest, rows["document_key"].eqNullSafe(newest["document_key"])).select("doc_id", "version_id", F.when(F.col("version_id") == F.col("newest"), "ACTIVE").otherwise("SUPERSEDED").alias("version_status"))
    return S.evidence_scope(rows, S.Scope()).select("doc_id")


def figure_scope(spark: SparkSession, d: str) -> DataFrame:
    """One source for each document and version, by language."""
    rows = table(spark, d, "sources").where("source_id is not null").select("document_key", "version", "language", "source_id", "source_updated_at")
    return S.one_for_each(rows, ["document_key", "version"], "language", ["source_id", "source_updated_at"]).select("document_key", "version", "language", "source_id")


def safe_trace(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    hits = R.best_hits(chunks, _queries(spark, d), 5)
    return S.safe_trace(hits)


def source_names(spark: SparkSession, d: str) -> DataFrame:
    """Sources of two versions whose path or key holds a word, whatever its case."""
    rows = S.in_versions(table(spark, d, "sources"), {"v2.0.0", "v2.1.0"})
    return rows.where(F.lower(F.concat_ws(" ", "document_path", "document_key")).contains("guides")).select("source_id", "version", "document_key")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of the largest document key's Chinese text in one version."""
    return S.document_rows(table(spark, d, "chunks"), "v2.1.1:zh:guides/pipeline-overview").select("pos", "chunk_id", "heading")


def figure_topk(spark: SparkSession, d: str) -> DataFrame:
    """At most three figure rows a query: BM25 of repeated query terms within the scope's own statistics, two terms in the content itself; English chunks stand in for figures."""
    rows = table(spark, d, "chunks").where("language = 'en'").select("pos", "chunk_id", "document_key", "heading", "content")
    return R.figure_hits(rows, _queries(spark, d), 5, 3)


def merged_figures(spark: SparkSession, d: str) -> DataFrame:
    """Five hits of each query with up to two figures merged in."""
    chunks = _chunks(spark, d)
    hits = R.best_hits(chunks, _queries(spark, d), 5).select("query_id", F.lit(0).alias("figure"), "rank", "pos", F.col("document_id").alias("document"))
    figures = figure_topk(spark, d).where("rank <= 2").join(chunks.select("pos", "document_id"), "pos").select("query_id", F.lit(1).alias("figure"), "rank", "pos", F.col("document_id").alias("document"))
    return E.by_request(
        hits.unionByName(figures), "query_id", ["figure", "rank"], lambda g: E.merge_images([r for r in g if not r["figure"]], [r for r in g if r["figure"]], 5),
        "query_id bigint, figure int, pos bigint, document string, place int",
    )


def path_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's ten best hits, how many words of the query their key and heading hold."""
    chunks = _chunks(spark, d)
    hits = R.best_hits(chunks, _queries(spark, d), 10).select("query_id", "pos")
    rows = hits.join(_queries(spark, d), "query_id").join(table(spark, d, "chunks").select("pos", "document_key", "heading"), "pos")
    return rows.select("query_id", "pos", C.path_overlap(F.col("query"), F.col("document_key"), F.col("heading")).alias("overlap"))


def canonical_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the canonical JSON of every item's metadata."""
    rows = table(spark, d, "engineering_snapshots").select("snapshot_no", "item_id", "delivered_at", C.canonical_hash(F.to_json("metadata")).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("rows"), F.min("item_id").alias("first_item"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("content is not null")
    identity = F.coalesce(url_identity(F.col("source_url")), F.col("document_id"))
    return rows.select("pos", "chunk_id", identity.alias("source_identity"), content_hash(F.col("content")).alias("content_hash"), F.coalesce("heading", F.lit("")).alias("section"), F.col("version").alias("version_id"))


def _evidence_id() -> Column:
    fields = F.struct("chunk_id", "content_hash", F.lit(None).cast("int").alias("page_number"), "section", "source_identity", "version_id")
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256), 1, 20))


def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    """The identity of every chunk as evidence: source, section, content and version."""
    return _evidence(spark, d).select("pos", _evidence_id().alias("evidence_id"))


def evidence_kept(spark: SparkSession, d: str) -> DataFrame:
    """Evidence without repeats: the first of each identity, and of these the first of each source and content."""
    rows = _evidence(spark, d).withColumn("evidence_id", _evidence_id())
    return S.first_kept(rows, "pos", ["evidence_id"], ["source_identity", "content_hash"]).select("pos", "evidence_id")


def change_keys(spark: SparkSession, d: str) -> DataFrame:
    """One key for each recorded change, the same whenever it is recorded again."""
    parts = ("project_id", "external_identifier", "change_type", "old_content_hash", "new_content_hash")
    key = F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)
    return table(spark, d, "item_changes").groupBy(key.alias("key")).agg(F.count("*").alias("rows"), F.min("recorded_at").alias("first_recorded"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Every case as the answer it would be: its summary as claim, its sources as evidence."""
    claim = F.struct(F.col("summary").alias("text"), F.col("required_sources").alias("evidence_ids"))
    whole = F.struct(F.array(claim).alias("claims"), F.array().cast("array<struct<document_id:string,page_number:int>>").alias("relevant_sources"))
    return table(spark, d, "cases").select("pos", F.to_json(whole, {"ignoreNullFields": "false"}).alias("payload"))


def decoded_answers(spark: SparkSession, d: str) -> DataFrame:
    return _payloads(spark, d).select("pos", C.decoded_answer("payload").alias("a")).select("pos", "a.valid", "a.claims", F.size("a.cited").alias("cited"))


def decoded_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Every case as the review it would be: its sources as candidates."""
    candidate = F.transform("required_sources", lambda s: F.struct(s.alias("evidence_chunk_id"), F.col("category").alias("reason"), F.col("change_type").alias("suggested_action")))
    none = F.array().cast("array<string>")
    whole = F.struct(F.col("summary").alias("change_interpretation"), candidate.alias("impact_candidates"), *(none.alias(n) for n in ("evidence_gaps", "version_ambiguities", "reviewer_actions")), F.lit("REQUIRES_HUMAN_REVIEW").alias("review_status"))
    rows = table(spark, d, "cases").select("pos", F.to_json(whole, {"ignoreNullFields": "false"}).alias("payload"))
    return rows.select("pos", C.decoded_review("payload").alias("a")).select("pos", "a.valid", F.size("a.candidates").alias("candidates"))


def aliased_claims(spark: SparkSession, d: str) -> DataFrame:
    """Required sources cited by the short name E<rank> of the query's hit where there is one: whether all citations of a query resolve to hits, each to another."""
    hits = _hits(spark, d, depth=5).groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    cited = _truth(spark, d).distinct().join(hits, ["query_id", "source"], "left").select("query_id", F.when(F.col("rank").isNotNull(), F.concat(F.lit("E"), F.col("rank"))).otherwise(F.col("source")).alias("cited"))
    names = hits.select("query_id", F.concat(F.lit("E"), F.col("rank")).alias("cited"), "source")
    resolved = cited.join(names, ["query_id", "cited"], "left")
    return resolved.groupBy("query_id").agg(F.count("*").alias("cited"), F.countDistinct("source").alias("resolved")).withColumn("valid", F.col("cited") == F.col("resolved"))


def review_candidates_outside(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of reviews (required sources) that are no hits of their query: none may be left in a review that is taken."""
    return _truth(spark, d).distinct().join(_hits(spark, d).select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")


def url_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sources").select("source_id", C.url_summary(F.col("source_url")).alias("u"))
    return rows.groupBy("u.type", "u.scheme", "u.host", "u.sha256").agg(F.count("*").alias("rows"))


def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every case text taken as the message of a failure."""
    rows = table(spark, d, "cases").select("pos", C.error_class(F.concat_ws(" ", "query", "summary")).alias("e"))
    return rows.select("pos", "e.code", "e.retryable")


def delivery_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "engineering_snapshots").groupBy("project_id", "snapshot_no").agg(C.utc_minute(F.max("delivered_at")).alias("delivered"))


def safe_contents(spark: SparkSession, d: str) -> DataFrame:
    """Source addresses and contents made safe to show: length and hash of the safe text."""
    text = C.safe_text(F.concat_ws(" ", "source_url", "content"), 100_000)
    return table(spark, d, "chunks").select("pos", text.alias("t")).select("pos", F.char_length("t").alias("length"), F.sha2("t", 256).alias("sha256"))


def safe_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "engineering_snapshots").select(C.safe_json(F.to_json(F.struct("metadata", F.col("content").alias("access_token")))).alias("safe"))
    return rows.groupBy("safe").agg(F.count("*").alias("rows"))


def figure_notices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.figure_notices(F.col("text")).alias("t")).select("doc_id", F.sha2("t", 256).alias("sha256"))


def first_families(spark: SparkSession, d: str) -> DataFrame:
    """The first two families of each category, in the order of a keyed hash, go to dev, the others to holdout."""
    rows = table(spark, d, "cases").where("family_id is not null and category is not null").select("pos", "category", "family_id")
    families = rows.select("category", "family_id").distinct().withColumn("h", F.sha2(F.concat_ws("|", F.lit("split"), "category", "family_id"), 256))
    first = R.ranked(families, [F.asc("h")], 2, by="category").select("category", "family_id", F.lit("dev").alias("split"))
    return rows.join(first, ["category", "family_id"], "left").select("pos", F.coalesce("split", F.lit("holdout")).alias("split"))


def clause_first_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of the first clause, or of the whole text where the clause says nothing."""
    first = keyword_class(F.split("summary", CLASS_CLAUSE)[0], CLASSES, "")
    rows = table(spark, d, "cases").where("summary is not null")
    return rows.select("pos", F.when(first != "", first).otherwise(keyword_class(F.col("summary"), CLASSES)).alias("change_class"))


def eval_v4(spark: SparkSession, d: str) -> DataFrame:
    """For each query: recall at 20, hit and completeness at 5, hits of another version, reciprocal rank, and nDCG where every relevant chunk gains."""
    chunks, cases = _chunks(spark, d), table(spark, d, "cases").select(F.col("pos").alias("query_id"), F.col("version").alias("wanted_version"), "answerable")
    hits = R.best_hits(chunks, _queries(spark, d), 20).select("query_id", "rank", F.col("document_id").alias("source"), "version")
    truth = _truth(spark, d)
    five, twenty = M.per_query(hits, truth, 5, ndcg="chunk"), M.per_query(hits, truth, 20).select("query_id", F.col("recall").alias("recall_at_20"))
    wrong = hits.join(cases, "query_id").groupBy("query_id").agg(F.count_if(F.col("wanted_version").isNotNull() & ~F.col("version").eqNullSafe(F.col("wanted_version"))).alias("version_mismatch"))
    out = five.join(twenty, "query_id").join(wrong, "query_id", "left")
    return out.select("query_id", F.round("recall_at_20", 6).alias("recall_at_20"), "hit_at_k", "complete", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"), F.coalesce("version_mismatch", F.lit(0)).alias("version_mismatch"))


def abstention(spark: SparkSession, d: str) -> DataFrame:
    """Queries left without an answer where the best score is low, against those that have none: precision and recall over all, by category and by language."""
    cases = table(spark, d, "cases").where("pos % 100 = 0 and query is not null and answerable is not null").select(F.col("pos").alias("query_id"), F.coalesce("category", F.lit("-")).alias("category"), F.coalesce("language", F.lit("-")).alias("language"), "answerable")
    rows = cases.join(_hits(spark, d, depth=1).select("query_id", "score"), "query_id", "left").withColumn("left_out", F.coalesce(F.col("score") < 20, F.lit(True)))
    right, said, had = F.count_if(F.col("left_out") & ~F.col("answerable")), F.count_if("left_out"), F.count_if(~F.col("answerable"))
    rate = lambda a, b: F.round(F.when(b == 0, 1.0).otherwise(a / b), 6)
    return rows.groupingSets([[], ["category"], ["language"]], "category", "language").agg(F.count("*").alias("queries"), said.alias("abstained"), rate(right, said).alias("precision"), rate(right, had).alias("recall"))


def scope_errors(spark: SparkSession, d: str) -> DataFrame:
    """By category: queries, hits of another language or version than the case's, and mean recall."""
    chunks = _chunks(spark, d)
    cases = table(spark, d, "cases").select(F.col("pos").alias("query_id"), F.coalesce("category", F.lit("-")).alias("category"), F.col("language").alias("own_language"), F.col("version").alias("own_version"))
    hits = R.best_hits(chunks, _queries(spark, d), 5).join(cases, "query_id")
    wrong = hits.groupBy("query_id").agg(F.count_if(F.col("language") != F.col("own_language")).alias("l"), F.count_if(F.col("version") != F.col("own_version")).alias("v"))
    rows = _queries(spark, d).select("query_id").join(cases, "query_id").join(wrong, "query_id", "left")
    rows = rows.join(M.per_query(_hits(spark, d, depth=5), _truth(spark, d)).select("query_id", "recall"), "query_id", "left")
    return rows.groupBy("category").agg(F.count("*").alias("queries"), F.sum(F.coalesce("l", F.lit(0))).alias("wrong_language"), F.sum(F.coalesce("v", F.lit(0))).alias("wrong_version"), F.round(F.avg("recall"), 6).alias("recall"))


def diversity_gain(spark: SparkSession, d: str) -> DataFrame:
    """Distinct documents among each query's five hits, before and after the source-diverse order."""
    chunks = _chunks(spark, d)
    scored = R.best_by_document(chunks, _queries(spark, d), 7)
    before = R.ranked(scored, [F.desc("score"), F.asc("pos")], 5).groupBy("query_id").agg(F.countDistinct("document_id").alias("before"))
    after = R.source_diverse(scored, 2, 5).groupBy("query_id").agg(F.countDistinct("document_id").alias("after"))
    return before.join(after, "query_id")


def saved_answers(spark: SparkSession, d: str) -> DataFrame:
    """Recorded changes (answers) of every project against its items (cases), and the deliveries that name another hash (reviews); changes without an item are counted, not dropped."""
    said = table(spark, d, "item_changes").select("project_id", F.lower(F.trim("external_identifier")).alias("identifier"), F.col("new_content_hash").alias("said"))
    own = table(spark, d, "engineering_snapshots").groupBy("project_id", F.lower(F.trim("external_identifier")).alias("identifier")).agg(F.collect_set("content_hash").alias("hashes"))
    rows = said.join(own, ["project_id", "identifier"], "left")
    return rows.groupBy("project_id").agg(
        F.count("*").alias("answers"), F.count_if(F.col("hashes").isNull()).alias("without_item"), F.count_if(F.array_contains("hashes", F.col("said"))).alias("confirmed"),
        F.count_if(F.col("hashes").isNotNull() & F.col("said").isNotNull() & ~F.array_contains("hashes", F.col("said"))).alias("mismatched"),
    )


def refresh_summary(spark: SparkSession, d: str) -> DataFrame:
    """For each document version: its cases, those that need nothing newer, and those to refresh, sorted."""
    cases = table(spark, d, "cases").where("case_id is not null").select("case_id", F.explode("required_sources").alias("document_id")).distinct()
    rows = cases.join(_catalog(spark, d).select("document_id", "status"), "document_id")
    stale = rows.groupBy("case_id").agg(F.count("*").alias("sources"), F.array_sort(F.collect_set(F.when(F.col("status") == "SUPERSEDED", F.col("document_id")))).alias("stale"))
    return stale.select("case_id", "sources", F.size("stale").alias("stale_sources"), F.array_join("stale", ",").alias("stale_documents"))


def marker_containment(spark: SparkSession, d: str) -> DataFrame:
    """For each query and required source: how many identifiers of the query a chunk of that source holds, as a part of its text and whatever the case."""
    markers = table(spark, d, "cases").where("pos % 100 = 0 and query is not null").select(F.col("pos").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all("query", F.lit("[a-z]+\\.[a-z_]+"), F.lit(0)))).alias("marker"))
    wanted = _truth(spark, d).distinct().join(markers, "query_id")
    texts = table(spark, d, "chunks").where("content is not null").select(F.col("document_id").alias("source"), F.lower("content").alias("text"))
    held = wanted.join(texts, "source").where(F.col("text").contains(F.lower("marker"))).select("query_id", "source", "marker").distinct().withColumn("held", F.lit(1))
    return wanted.join(held, ["query_id", "source", "marker"], "left").groupBy("query_id", "source").agg(F.count("*").alias("markers"), F.count("held").alias("held"))


def request_plans(spark: SparkSession, d: str) -> DataFrame:
    """Every case summary as a plan of at most four searches: each facet with its kind, the whole text's where the facet says nothing."""
    rows = table(spark, d, "cases").where("summary is not null").select("pos", keyword_class(F.col("summary"), CLASSES).alias("whole"), F.posexplode(R.facets(F.col("summary"))).alias("step", "search_query"))
    own = keyword_class(F.col("search_query"), CLASSES, "")
    return rows.select("pos", "step", F.when(own != "", own).otherwise(F.col("whole")).alias("kind"), "search_query")


def planned_queries(spark: SparkSession, d: str) -> DataFrame:
    """For each suite and category at most three different searches, a primary one and two to fall back on, without those asked already (the queries of the suite's cases)."""
    rows = table(spark, d, "cases").where("suite is not null and category is not null")
    asked = rows.groupBy("suite").agg(F.collect_set("query").alias("asked"))
    texts = [F.concat_ws(" ", *parts) for parts in (("suite", "category"), ("language", "category", F.lit("要求")), ("suite", "category", F.lit("相关说明")))]
    plan = rows.select("suite", "category", "language", F.array_distinct(F.array(*(F.trim(F.regexp_replace(t, "\\s+", " ")) for t in texts))).alias("texts")).distinct()
    left = plan.join(asked, "suite").select("suite", "category", "language", F.posexplode(F.slice(F.filter("texts", lambda t: (t != "") & ~F.array_contains("asked", t)), 1, 3)).alias("step", "search_query"))
    return left.select("suite", "category", "language", "step", "search_query")


_PATTERNS = [("parameter", "[a-z]+\\.[a-z_]+"), ("release", "v[0-9]+\\.[0-9]+"), ("requirement", "REQ-[0-9]+")]


def profile_matches(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the named patterns of a user's profile."""
    return E.profile_matches(table(spark, d, "chunks"), "content", _PATTERNS).groupBy("pattern").agg(F.count("*").alias("chunks"), F.min("pos").alias("first_pos"))


def compound_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The queries with compounds written as the corpus writes them."""
    return R.compound_aliases(_queries(spark, d), I.postings(R.corpus_index(_chunks(spark, d)), "body"))


QUERIES = {
    f.__name__: f
    for f in (
        version_scopes, catalog_scope, catalog_history_scope, item_scope, evidence_scope, figure_scope, safe_trace, source_names, document_chunks, figure_topk, merged_figures, path_overlaps, canonical_hashes,
        evidence_ids, evidence_kept, change_keys, decoded_answers, decoded_reviews, aliased_claims, review_candidates_outside, url_summaries, failure_classes, delivery_times, safe_contents, safe_metadata,
        figure_notices, first_families, clause_first_classes, eval_v4, abstention, scope_errors, diversity_gain, saved_answers, refresh_summary,
        marker_containment, request_plans, planned_queries, profile_matches, compound_aliases,
    )
}

_CAT = """cat AS (SELECT concat_ws(':', version, language, document_key) AS document_id, version AS version_id, max(repository) AS project_id, max(source_type) AS document_type,
  CASE WHEN version = max(version) OVER (PARTITION BY document_key, language) THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status
  FROM sources WHERE version IS NOT NULL AND language IS NOT NULL AND document_key IS NOT NULL GROUP BY document_key, language, version)"""
_PLACE = "regexp_extract(source_url, '^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(:\\d+)?([^?#]*)', {})"
_EV = f"""ev AS (SELECT pos, chunk_id, source_url AS source_identity, sha256({sql_squeeze('content')}) AS content_hash, coalesce(heading, '') AS section, version AS version_id FROM chunks WHERE content IS NOT NULL),
ei AS (SELECT *, 'ev_' || substr(sha256('{{' || concat_ws(',', '"chunk_id":' || to_json(chunk_id)::VARCHAR, '"content_hash":"' || content_hash || '"', '"page_number":null', '"section":' || to_json(section)::VARCHAR,
  '"source_identity":' || to_json(source_identity)::VARCHAR, '"version_id":' || to_json(version_id)::VARCHAR) || '}}'), 1, 20) AS evidence_id FROM ev)"""
_TOP = "SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM bm WHERE score > 0"
_CLAUSE_SQL = "regexp_split_to_array(summary, '[;；。\\n]+')[1]"


def _class_sql(text: str, default: str) -> str:
    def there(term: str) -> str:
        low = f"lower(coalesce({text}, ''))"
        return f"regexp_matches({low}, '(^|[^a-z0-9_]){term}($|[^a-z0-9_])')::INT" if term.isascii() else f"contains({low}, '{term}')::INT"

    counts = [" + ".join(there(t) for t in terms) for terms in CLASSES.values()]
    most = f"greatest({', '.join(counts)})"
    return "CASE WHEN " + f"{most} = 0 THEN '{default}' " + " ".join(f"WHEN ({c}) = {most} THEN '{n}'" for n, c in zip(CLASSES, counts)) + " END"


def _failure_sql(message: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains({message}, '{p}')" for p in phrases) + f" THEN '{code}'" for code, _, phrases in C.PHRASES)
    return f"CASE {arms} ELSE 'INTERNAL_ERROR' END"


SQL = {
    "version_scopes": """SELECT 'current' AS scope, count(*) AS chunks FROM chunks WHERE version = (SELECT max(version) FROM sources) UNION ALL SELECT 'all', count(*) FROM chunks
UNION ALL SELECT 'first_series', count(*) FROM chunks WHERE version IN ('v1.4.0', 'v1.5.0', 'v1.6.2') UNION ALL SELECT 'v2.0.0', count(*) FROM chunks WHERE version = 'v2.0.0'""",
    "catalog_scope": f"WITH {_CAT} SELECT pos FROM chunks WHERE document_id IN (SELECT document_id FROM cat WHERE status = 'ACTIVE' AND project_id = 'lanternworks/edge-kit' AND document_type = 'markdown')",
    "catalog_history_scope": f"WITH {_CAT} SELECT pos FROM chunks WHERE document_id IN (SELECT document_id FROM cat WHERE version_id IN ('v1.5.0', 'v2.0.0'))",
    "item_scope": "SELECT snapshot_no, project_id, item_id, delivered_at FROM engineering_snapshots WHERE organization_id = 'org_amber' AND document_id = 'requirements'",
    "evidence_scope": "SELECT doc_id FROM (SELECT doc_id, version, max(version) OVER (PARTITION BY document_key) AS newest FROM documents) WHERE version IS NULL OR version = newest",
    "figure_scope": """WITH s AS (SELECT *, CASE WHEN (SELECT count(*) FROM sources WHERE language = 'zh' AND source_id IS NOT NULL) > 0 THEN 'zh' ELSE 'en' END AS pref FROM sources WHERE source_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY document_key, version ORDER BY coalesce(language = pref, false) DESC, CASE WHEN language = pref THEN source_id END DESC, source_id, CASE WHEN language = pref THEN source_updated_at END DESC, source_updated_at) AS n FROM s)
SELECT document_key, version, language, source_id FROM r WHERE n = 1""",
    "safe_trace": f"WITH {_bm25_sql()}, h AS ({_TOP}) SELECT query_id, rank, document_id, version, score FROM h JOIN chunks USING (pos) WHERE rank <= 5",
    "source_names": "SELECT source_id, version, document_key FROM sources WHERE version IN ('v2.0.0', 'v2.1.0') AND contains(lower(concat_ws(' ', document_path, document_key)), 'guides')",
    "document_chunks": "SELECT pos, chunk_id, heading FROM chunks WHERE document_id = 'v2.1.1:zh:guides/pipeline-overview'",
    "figure_topk": f"""WITH fc AS (SELECT pos, chunk_id, concat_ws(' ', coalesce(heading, ''), coalesce(document_key, ''), coalesce(content, '')) AS whole, content FROM chunks WHERE language = 'en'),
qs AS (SELECT pos AS query_id, query FROM cases WHERE pos % 100 = 0 AND query IS NOT NULL),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens('query')}) AS term FROM qs) GROUP BY 1, 2),
ft AS (SELECT pos, {sql_tokens('whole')} AS t, {sql_tokens('content')} AS own FROM fc), st AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS al FROM ft),
ps AS (SELECT pos, term, count(*) AS tf, any_value(l) AS l FROM (SELECT pos, len(t) AS l, unnest(t) AS term FROM ft) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM ps GROUP BY 1), oc AS (SELECT DISTINCT pos, term FROM (SELECT pos, unnest(own) AS term FROM ft)),
two AS (SELECT query_id, pos FROM qt JOIN oc USING (term) GROUP BY 1, 2 HAVING count(*) >= 2),
sc AS (SELECT query_id, pos, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score FROM qt JOIN df USING (term) JOIN ps USING (term), st GROUP BY 1, 2)
SELECT query_id, rank, pos, score FROM (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, pos) AS rank FROM sc JOIN two USING (query_id, pos) JOIN fc USING (pos) WHERE score > 0) WHERE rank <= 3""",
    "path_overlaps": f"""WITH {_bm25_sql()}, h AS ({_TOP}), w AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-z][a-z0-9]*')) AS words FROM qs),
j AS (SELECT query_id, h.pos, words, regexp_replace(lower(concat_ws(' ', coalesce(document_key, ''), coalesce(heading, ''))), '[^a-z0-9]+', '', 'g') AS src FROM h JOIN chunks USING (pos) JOIN w USING (query_id) WHERE rank <= 10)
SELECT query_id, pos, len(list_filter(words, lambda x: length(x) > 2 AND x NOT IN ('guide', 'task', 'docs', 'official', 'check', 'verify', 'and', 'the', 'what', 'does', 'how', 'is', 'for', 'with', 'parent', 'child') AND contains(src, x)))::INT AS overlap FROM j""",
    "canonical_hashes": """WITH m AS (SELECT item_id, '{' || array_to_string(list_sort(list_transform(map_entries(metadata), lambda e: to_json(e.key)::VARCHAR || ':' || to_json(e.value)::VARCHAR)), ',') || '}' AS j, metadata FROM engineering_snapshots)
SELECT CASE WHEN metadata IS NULL THEN NULL ELSE sha256(j) END AS hash, count(*) AS rows, min(item_id) AS first_item FROM m GROUP BY 1""",
    "evidence_ids": f"WITH {_EV} SELECT pos, evidence_id FROM ei",
    "evidence_kept": f"WITH {_EV}, a AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY pos) AS n FROM ei), b AS (SELECT *, row_number() OVER (PARTITION BY source_identity, content_hash ORDER BY pos) AS m FROM a WHERE n = 1) SELECT pos, evidence_id FROM b WHERE m = 1",
    "change_keys": "SELECT sha256(concat_ws('|', coalesce(project_id, ''), coalesce(external_identifier, ''), coalesce(change_type, ''), coalesce(old_content_hash, ''), coalesce(new_content_hash, ''))) AS key, count(*) AS rows, min(recorded_at) AS first_recorded FROM item_changes GROUP BY 1",
    "decoded_answers": """WITH v AS (SELECT pos, summary IS NOT NULL AND trim(summary) <> '' AND length(summary) <= 1000 AND required_sources IS NOT NULL AND len(required_sources) BETWEEN 1 AND 5 AND len(list_distinct(required_sources)) = len(required_sources)
  AND len(list_filter(required_sources, lambda s: s IS NULL OR trim(s) = '' OR length(s) > 250)) = 0 AS valid, len(required_sources) AS k FROM cases)
SELECT pos, coalesce(valid, false) AS valid, CASE WHEN valid THEN 1 END::INT AS claims, CASE WHEN valid THEN k END::INT AS cited FROM v""",
    "decoded_reviews": """WITH v AS (SELECT pos, summary IS NOT NULL AND length(summary) <= 1000 AND required_sources IS NOT NULL AND len(required_sources) <= 5 AND len(list_distinct(required_sources)) = len(required_sources)
  AND (len(required_sources) = 0 OR category IS NOT NULL AND trim(category) <> '' AND change_type IS NOT NULL AND trim(change_type) <> '') AS valid, len(required_sources) AS k FROM cases)
SELECT pos, coalesce(valid, false) AS valid, CASE WHEN valid THEN k END::INT AS candidates FROM v""",
    "aliased_claims": f"""WITH {_bm25_sql()}, {_hits_sql('h', 'bm')}, hh AS (SELECT query_id, source, min(rank) AS rank FROM h WHERE rank <= 5 GROUP BY 1, 2), t AS (SELECT DISTINCT pos AS query_id, unnest(required_sources) AS source FROM cases WHERE pos % 100 = 0 AND query IS NOT NULL)
SELECT query_id, count(*) AS cited, count(DISTINCT hh.source) AS resolved, count(*) = count(DISTINCT hh.source) AS valid FROM t LEFT JOIN hh USING (query_id, source) GROUP BY 1""",
    "review_candidates_outside": f"WITH {_bm25_sql()}, {_hits_sql('h', 'bm')}, t AS (SELECT DISTINCT pos AS query_id, unnest(required_sources) AS source FROM cases WHERE pos % 100 = 0 AND query IS NOT NULL) SELECT query_id, source FROM t ANTI JOIN h USING (query_id, source)",
    "url_summaries": f"""WITH p AS (SELECT {_PLACE.format(1)} AS s, {_PLACE.format(2)} AS h, {_PLACE.format(3)} AS o, {_PLACE.format(4)} AS p, source_url FROM sources)
SELECT CASE WHEN h <> '' THEN 'url' ELSE 'invalid_url' END AS type, CASE WHEN h <> '' THEN lower(s) END AS scheme, CASE WHEN h <> '' THEN lower(h) || o END AS host, CASE WHEN h <> '' THEN sha256(CASE WHEN p = '' THEN '/' ELSE p END) ELSE sha256(source_url) END AS sha256, count(*) AS rows FROM p GROUP BY 1, 2, 3, 4""",
    "failure_classes": f"WITH m AS (SELECT pos, lower(concat_ws(' ', query, summary)) AS m FROM cases), c AS (SELECT pos, {_failure_sql('m')} AS code FROM m) SELECT pos, code, code IN ('RATE_LIMITED', 'OPERATION_TIMEOUT', 'TRANSIENT_NETWORK') AS retryable FROM c",
    "delivery_times": "SELECT project_id, snapshot_no, strftime(max(delivered_at)::TIMESTAMP, '%Y-%m-%d %H:%M UTC') AS delivered FROM engineering_snapshots GROUP BY 1, 2",
    "first_families": """WITH f AS (SELECT DISTINCT category, family_id FROM cases WHERE family_id IS NOT NULL AND category IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('split|' || category || '|' || family_id)) AS n FROM f)
SELECT pos, CASE WHEN n <= 2 THEN 'dev' ELSE 'holdout' END AS split FROM cases JOIN r USING (category, family_id)""",
    "clause_first_classes": f"WITH c AS (SELECT pos, {_class_sql(_CLAUSE_SQL, '')} AS a, {_class_sql('summary', 'general')} AS b FROM cases WHERE summary IS NOT NULL) SELECT pos, CASE WHEN a <> '' THEN a ELSE b END AS change_class FROM c",
    "abstention": f"""WITH {_bm25_sql()}, {_hits_sql('h', 'bm')}, c AS (SELECT pos AS query_id, coalesce(category, '-') AS category, coalesce(language, '-') AS language, answerable FROM cases WHERE pos % 100 = 0 AND query IS NOT NULL AND answerable IS NOT NULL),
r AS (SELECT c.*, coalesce(score < 20, true) AS lo FROM c LEFT JOIN (SELECT query_id, score FROM h WHERE rank = 1) USING (query_id))
SELECT category, language, count(*) AS queries, count(*) FILTER (lo) AS abstained, round(CASE WHEN count(*) FILTER (lo) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (lo AND NOT answerable) / count(*) FILTER (lo) END, 6) AS precision,
round(CASE WHEN count(*) FILTER (NOT answerable) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (lo AND NOT answerable) / count(*) FILTER (NOT answerable) END, 6) AS recall FROM r GROUP BY GROUPING SETS ((), (category), (language))""",
    "diversity_gain": f"""WITH {_bm25_sql()}, s AS (SELECT query_id, pos, score, document_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM bm JOIN chunks USING (pos) WHERE score > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY r) AS nth, min(r) OVER (PARTITION BY query_id, document_id) AS first_r FROM s),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN r <= 2 THEN 0 WHEN first_r > 2 AND nth = 1 THEN 1 ELSE 2 END, r) AS rank FROM g)
SELECT query_id, count(DISTINCT document_id) FILTER (r <= 5) AS before, count(DISTINCT document_id) FILTER (rank <= 5) AS after FROM v GROUP BY 1""",
    "saved_answers": """WITH o AS (SELECT project_id, lower(trim(external_identifier)) AS identifier, list(DISTINCT content_hash) FILTER (content_hash IS NOT NULL) AS hashes FROM engineering_snapshots GROUP BY 1, 2),
s AS (SELECT project_id, lower(trim(external_identifier)) AS identifier, new_content_hash AS said FROM item_changes)
SELECT project_id, count(*) AS answers, count(*) FILTER (o.identifier IS NULL) AS without_item, count(*) FILTER (o.identifier IS NOT NULL AND list_contains(hashes, said)) AS confirmed,
count(*) FILTER (o.identifier IS NOT NULL AND said IS NOT NULL AND NOT coalesce(list_contains(hashes, said), false)) AS mismatched FROM s LEFT JOIN o USING (project_id, identifier) GROUP BY 1""",
    "refresh_summary": f"""WITH {_CAT}, c AS (SELECT DISTINCT case_id, unnest(required_sources) AS document_id FROM cases WHERE case_id IS NOT NULL), r AS (SELECT case_id, document_id, status FROM c JOIN cat USING (document_id))
SELECT case_id, count(*) AS sources, count(DISTINCT document_id) FILTER (status = 'SUPERSEDED') AS stale_sources, coalesce(array_to_string(list_sort(list(DISTINCT document_id) FILTER (status = 'SUPERSEDED')), ','), '') AS stale_documents FROM r GROUP BY 1""",
    "marker_containment": """WITH m AS (SELECT pos AS query_id, unnest(list_distinct(regexp_extract_all(query, '[a-z]+\\.[a-z_]+'))) AS marker FROM cases WHERE pos % 100 = 0 AND query IS NOT NULL),
t AS (SELECT DISTINCT pos AS query_id, unnest(required_sources) AS source FROM cases WHERE pos % 100 = 0 AND query IS NOT NULL), w AS (SELECT query_id, source, marker FROM t JOIN m USING (query_id)),
c AS (SELECT document_id AS source, lower(content) AS text FROM chunks WHERE content IS NOT NULL), h AS (SELECT DISTINCT query_id, source, marker, 1 AS held FROM w JOIN c USING (source) WHERE contains(text, lower(marker)))
SELECT query_id, source, count(*) AS markers, count(held) AS held FROM w LEFT JOIN h USING (query_id, source, marker) GROUP BY 1, 2""",
    "request_plans": f"""WITH {_FACETS}, p AS (SELECT pos, facet_id AS step, facet AS search_query, summary FROM fs JOIN cases USING (pos)),
k AS (SELECT pos, step, search_query, {_class_sql('search_query', '')} AS own, {_class_sql('summary', 'general')} AS whole FROM p) SELECT pos, step::INT AS step, CASE WHEN own <> '' THEN own ELSE whole END AS kind, search_query FROM k""",
    "planned_queries": """WITH r AS (SELECT DISTINCT suite, category, language FROM cases WHERE suite IS NOT NULL AND category IS NOT NULL),
x AS (SELECT *, unnest([0, 1, 2]) AS n, unnest([concat_ws(' ', suite, category), concat_ws(' ', language, category, '要求'), concat_ws(' ', suite, category, '相关说明')]) AS q FROM r),
y AS (SELECT suite, category, language, q, min(n) AS n FROM x WHERE q <> '' AND (suite, q) NOT IN (SELECT suite, query FROM cases WHERE suite IS NOT NULL AND query IS NOT NULL) GROUP BY 1, 2, 3, 4)
SELECT suite, category, language, (row_number() OVER (PARTITION BY suite, category, language ORDER BY n) - 1)::INT AS step, q AS search_query FROM y""",
    "profile_matches": " UNION ALL ".join(f"SELECT '{n}' AS pattern, count(*) AS chunks, min(pos) AS first_pos FROM chunks WHERE regexp_matches(content, '{p}') HAVING count(*) > 0" for n, p in _PATTERNS),
}
