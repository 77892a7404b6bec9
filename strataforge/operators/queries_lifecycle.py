"""Queries of versions, catalogues, relations and evidence, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, sql_squeeze
from ..plans.tables import spread, table
from . import lifecycle as L
from .components import connected_components

_PARAMETER = "([a-z]+\\.[a-z_]+)(?: 设为 | is set to |=)([0-9]+(?:\\.[0-9]+)?)"


def _number():
    return F.expr("try_cast(regexp_extract(chunk_id, ':([0-9]+)$', 1) as bigint)")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """The latest ingested row of each chunk."""
    rows = table(spark, d, "chunks").select("pos", "chunk_id", "document_id", "document_key", "version", "language", "heading", "heading_path", "content", "repository", "ingested_at", "license")
    return L.latest(rows, ["chunk_id"], [F.desc("ingested_at"), F.desc("pos")])


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(table(spark, d, "sources"), ["version", "language", "document_key"], [F.desc("source_updated_at"), F.desc("source_id")])


def section_diff(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a document between every two consecutive existing versions of a document, in the order of their numbers."""
    rows = _pieces(spark, d).select("document_key", F.split("chunk_id", ":")[1].alias("lang"), _number().alias("number"), "version", content_hash(F.col("content")).alias("hash"))
    rows = rows.groupBy("document_key", "lang", "number", "version").agg(F.max("hash").alias("hash"))
    numbers = F.transform(F.regexp_extract_all("version", F.lit("([0-9]+)")), lambda x: x.cast("bigint"))
    keys = ["document_key", "from", "to", "lang", "number"]
    return L.keyed_diff(*L.stepped(rows, ["document_key"], "version", numbers), keys, "hash").select(*keys, "change_type")


def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.diff_summary(section_diff(spark, d), ["document_key", "from", "to"])


def item_diff(spark: SparkSession, d: str) -> DataFrame:
    """Items between every two consecutive existing snapshots of a project."""
    rows = table(spark, d, "engineering_snapshots").select("project_id", "snapshot_no", F.lower(F.trim("external_identifier")).alias("identifier"), content_hash(F.col("content")).alias("hash"), "delivered_at", "item_id")
    rows = L.latest(rows.where("identifier is not null"), ["project_id", "snapshot_no", "identifier"], [F.desc("delivered_at"), F.desc("hash"), F.desc("item_id")])
    keys = ["project_id", "from", "to", "identifier"]
    return L.keyed_diff(*L.stepped(rows, ["project_id"], "snapshot_no"), keys, "hash").select(*keys, "change_type")


def recorded_change_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "item_changes").groupBy("project_id", "change_type").agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("external_identifier"))).alias("identifiers"), F.max("recorded_at").alias("last_recorded"))


def chunk_enrichment(spark: SparkSession, d: str) -> DataFrame:
    src = _sources(spark, d).select("version", "language", "document_key", "source_id", "license_status", "publisher")
    rows = table(spark, d, "chunks").select("pos", "version", "language", "document_key").join(src, ["version", "language", "document_key"], "left")
    return rows.select("pos", "source_id", F.coalesce("license_status", F.lit("unknown")).alias("license_status"), F.coalesce("publisher", F.lit("unknown")).alias("publisher"))


def chunks_without_source(spark: SparkSession, d: str) -> DataFrame:
    return L.unmatched(table(spark, d, "chunks").select("pos", "version", "language", "document_key"), table(spark, d, "sources"), ["version", "language", "document_key"]).select("pos")


def duplicate_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return L.duplicate_keys(table(spark, d, "chunks"), ["chunk_id"])


def catalog_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _sources(spark, d).groupBy("document_key").agg(
        F.count("*").alias("version_rows"), F.countDistinct("version").alias("versions"), F.max_by("version", F.struct("source_updated_at", "version", "language")).alias("active_version"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("version_list"),
    )
    return rows


def version_catalog_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a rule of the catalogue, by rule."""
    src = table(spark, d, "sources")
    rules = {
        "repeated source id": L.duplicate_keys(src, ["source_id"]).select(F.col("source_id").alias("subject")),
        "repeated document version": L.duplicate_keys(src, ["version", "language", "document_key"]).select(F.concat_ws(":", "version", "language", "document_key").alias("subject")),
        "missing hash": src.where("sha256 is null").select(F.col("source_id").alias("subject")),
    }
    out = None
    for rule, rows in rules.items():
        part = rows.select(F.lit(rule).alias("rule"), "subject")
        out = part if out is None else out.union(part)
    return out.groupBy("rule").agg(F.count("*").alias("violations"), F.min("subject").alias("first_subject"))


def lineage_supersedes(spark: SparkSession, d: str) -> DataFrame:
    rows = _sources(spark, d).select("document_key", "language", "version", F.concat_ws(":", "version", "language", "document_key").alias("node"))
    return L.lineage(rows, ["document_key", "language"], "version", "node")


def document_catalogue(spark: SparkSession, d: str) -> DataFrame:
    title = table(spark, d, "chunks").groupBy("document_id").agg(F.min_by(F.coalesce("document_title", "heading"), "pos").alias("title"), F.count("*").alias("chunks"), F.countDistinct("heading").alias("headings"))
    return title.select("document_id", "title", "chunks", "headings")


def source_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sources")
    return rows.groupBy("version", "locale", "source_type", "license_status").agg(F.count("*").alias("rows"), F.countDistinct("document_key").alias("documents"))


def source_breakdown_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sources").select(F.coalesce("version", F.lit("-")).alias("version"), F.coalesce("language", F.lit("-")).alias("language"))
    return rows.groupingSets([[], ["version"], ["language"], ["version", "language"]], "version", "language").agg(F.count("*").alias("rows"))


def license_disposition(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.trim(F.coalesce("license_status", F.lit(""))))
    kind = F.when(s == "", "unknown").when(s.contains("review"), "reviewed").otherwise("other")
    return table(spark, d, "sources").groupBy(F.upper(F.trim(F.coalesce("license", F.lit("unknown")))).alias("license"), kind.alias("disposition")).agg(F.count("*").alias("rows"))


def relation_adjacency(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "cases").where("derived_from is not null").select("case_id", "derived_from").distinct()
    return L.adjacency(edges, "derived_from", "case_id").groupBy("node").agg(F.count_if(F.col("direction") == "out").alias("outgoing"), F.count_if(F.col("direction") == "in").alias("incoming"), F.countDistinct("neighbour").alias("neighbours"))


def relation_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cases").select("case_id", "derived_from", "family_id").distinct()
    known = rows.select(F.col("case_id").alias("derived_from"), F.lit(True).alias("known")).distinct()
    return rows.where("derived_from is not null").join(known, "derived_from", "left").groupBy(F.coalesce("known", F.lit(False)).alias("parent_known")).agg(F.count("*").alias("relations"), F.countDistinct("derived_from").alias("parents"))


def impact_discovery(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases")
    family = F.translate(F.lower(F.trim("family_id")), "- ", "__")
    one = cases.groupBy("case_id").agg(F.max("derived_from").alias("derived_from"), F.max("change_type").alias("change_type"), F.max(family).alias("family"))
    changed = one.where("derived_from is not null").select(F.col("derived_from").alias("item")).distinct()
    links = one.where("derived_from is not null").select(F.col("derived_from").alias("item"), F.col("case_id").alias("target"))
    kin = one.where("family is not null")
    suggestions = changed.join(kin.select(F.col("case_id").alias("item"), "family"), "item").join(kin.select("family", F.col("case_id").alias("target")), "family").select("item", "target")
    return L.impacts(changed, links, suggestions).groupBy("provenance", "status", "priority").agg(F.count("*").alias("impacts"), F.countDistinct("item").alias("items"), F.countDistinct("target").alias("targets"))


def consistency_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = _pieces(spark, d).select("document_key", "language", "heading", "version", content_hash(F.col("content")).alias("hash")).where("language is not null and heading is not null")
    return L.differing_versions(rows, ["document_key", "language", "heading"], "version", "hash")


def literal_differences(spark: SparkSession, d: str) -> DataFrame:
    hit = F.explode(F.expr(f"arrays_zip(regexp_extract_all(content, r'{_PARAMETER}', 1), regexp_extract_all(content, r'{_PARAMETER}', 2))"))
    rows = spread(table(spark, d, "chunks").select("pos", "document_key", "content"), "pos").where("content is not null").select("document_key", hit.alias("h")).select("document_key", F.col("h.0").alias("parameter"), F.col("h.1").alias("value"))
    own = rows.groupBy("document_key", "parameter").agg(F.countDistinct("value").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    return own.where("n_values >= 2")


def exact_identifier_match(spark: SparkSession, d: str) -> DataFrame:
    """Chunks naming an identifier that a case's query names; both sides extract identifiers, so the containment is an equi-join."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("[a-z]+\\.[a-z]+(?:_[a-z]+)+"), F.lit(0)))
    asked = table(spark, d, "cases").where("pos % 100 = 0 and query is not null").select("pos", F.explode(found("query")).alias("identifier"))
    named = table(spark, d, "chunks").where("content is not null").select("document_key", F.explode(found("content")).alias("identifier"))
    return asked.join(named, "identifier").groupBy("pos", "identifier").agg(F.count("*").alias("chunks"), F.countDistinct("document_key").alias("documents"))


def freshness_join(spark: SparkSession, d: str) -> DataFrame:
    src = _sources(spark, d)
    active = src.groupBy(F.col("document_key").alias("document")).agg(F.max("version").alias("active_version"))
    evidence = table(spark, d, "chunks").select("pos", F.col("document_key").alias("document"), "version", F.lit(False).alias("historical"))
    return L.freshness(evidence, active).groupBy("freshness").agg(F.count("*").alias("chunks"), F.countDistinct("document").alias("documents"))


def affected_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases with a required source that is not of its document's newest version."""
    active = _sources(spark, d).groupBy("document_key").agg(F.max("version").alias("active_version"))
    need = table(spark, d, "cases").select("case_id", F.explode("required_sources").alias("source"))
    need = need.select("case_id", "source", F.split("source", ":")[0].alias("version"), F.split("source", ":")[2].alias("document_key"))
    stale = need.join(active, "document_key").where("version <> active_version")
    return stale.groupBy("case_id").agg(F.countDistinct("source").alias("stale_sources"))


def section_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return L.neighbours(table(spark, d, "chunks").select("document_id", "heading", "pos"), ["document_id", "heading"], "pos", 2)


def section_anchor(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").groupBy("document_id", "heading").agg(F.min("pos").alias("anchor"), F.count("*").alias("chunks"))
    return rows


def incremental_embedding_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Distinct contents of the newest version that need no new vector, as an older version has the same content."""
    rows = _pieces(spark, d).where("content is not null").select("document_key", "version", content_hash(F.col("content")).alias("hash")).distinct()
    newest = rows.groupBy("document_key").agg(F.max("version").alias("newest"))
    tagged = rows.join(newest, "document_key")
    old = tagged.where("version < newest").select("document_key", "hash").distinct().withColumn("known", F.lit(1))
    now = tagged.where("version = newest").select("document_key", "hash").distinct().join(old, ["document_key", "hash"], "left")
    return now.groupBy("document_key").agg(F.count("known").alias("reused"), (F.count("*") - F.count("known")).alias("missing"))


def union_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and evaluation passages as one table of reviewable texts; columns of one side are null on the other."""
    a = table(spark, d, "chunks").select(F.col("chunk_id").alias("item"), "language", "document_key", F.char_length("content").alias("chars"))
    b = table(spark, d, "eval_passages").select(F.col("item_id").cast("string").alias("item"), "language", F.char_length("passage").alias("chars"), "suite")
    return a.unionByName(b, allowMissingColumns=True).groupBy("language", F.col("suite").isNotNull().alias("held_out")).agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"))


def required_sources_found(spark: SparkSession, d: str) -> DataFrame:
    """For each case the required sources that exist as documents and those that do not."""
    have = table(spark, d, "chunks").select(F.col("document_id").alias("source"), F.lit(1).alias("there")).distinct()
    need = table(spark, d, "cases").select("case_id", F.explode("required_sources").alias("source")).distinct()
    return need.join(have, "source", "left").groupBy("case_id").agg(F.count("there").alias("found"), (F.count("*") - F.count("there")).alias("absent"))


def append_only_extension(spark: SparkSession, d: str) -> DataFrame:
    """Per project and two consecutive existing snapshots: rows of the first not present in the second, equal in all columns but those of the delivery (ids of item and version, time)."""
    rows = table(spark, d, "engineering_snapshots").withColumn("metadata", F.array_sort(F.map_entries("metadata"))).drop("item_id", "version_id", "delivered_at")
    old, new = L.stepped(rows, ["project_id"], "snapshot_no")
    return old.exceptAll(new.select(*old.columns)).groupBy("project_id", "from", "to").agg(F.count("*").alias("lost_rows"))


def evidence_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of each (document, content) in order of position."""
    rows = table(spark, d, "chunks").select("pos", "document_key", content_hash(F.col("content")).alias("hash"))
    return L.latest(rows, ["document_key", "hash"], [F.asc("pos")]).select("pos", "document_key")


def family_components(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases")
    family = F.translate(F.lower(F.trim("family_id")), "- ", "__")
    edges = cases.where("family_id is not null").select(F.concat(F.lit("case "), "case_id").alias("a"), F.concat(F.lit("family "), family).alias("b"))
    edges = edges.union(cases.where("derived_from is not null").select(F.concat(F.lit("case "), "case_id"), F.concat(F.lit("case "), "derived_from")))
    return connected_components(edges).groupBy("root").agg(F.count_if(F.col("node").startswith("case ")).alias("cases"), F.count_if(F.col("node").startswith("family ")).alias("families"))


def family_split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Families that stand in more than one split."""
    family = F.translate(F.lower(F.trim("family_id")), "- ", "__").alias("family")
    rows = table(spark, d, "cases").select(family, F.lower(F.trim("split")).alias("split")).where("family is not null and split is not null")
    return rows.groupBy("family").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("rows")).where("splits > 1")


def hash_ordered_holdout(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of all families, those first by the hash of their name: ranked over ranges, not in one window."""
    from .ordering import running_total

    families = table(spark, d, "cases").select(F.translate(F.lower(F.trim("family_id")), "- ", "__").alias("family")).where("family is not null").distinct()
    keyed = families.select("family", F.sha2(F.concat(F.lit("7|"), "family"), 256).alias("h"), F.lit(1).cast("bigint").alias("one"))
    n = keyed.count()
    return running_total(keyed, ["h", "family"], "one", "place").select("family", F.when(F.col("place") <= int(n * 0.2 + 0.5), "holdout").otherwise("dev").alias("side"))


def alternating_split(spark: SparkSession, d: str) -> DataFrame:
    """Cases of each category dealt to two sides in turn by hash order."""
    from pyspark.sql import Window

    rows = table(spark, d, "cases").select("case_id", F.coalesce("category", F.lit("-")).alias("category")).distinct()
    nth = F.row_number().over(Window.partitionBy("category").orderBy(F.sha2("case_id", 256), "case_id"))
    return rows.select("case_id", "category", F.when(nth % 2 == 1, "dev").otherwise("holdout").alias("side"))


QUERIES = {
    f.__name__: f
    for f in (
        section_diff, diff_summary, item_diff, recorded_change_summary, chunk_enrichment, chunks_without_source, duplicate_chunk_ids, catalog_rows, version_catalog_checks, lineage_supersedes,
        document_catalogue, source_breakdown, source_breakdown_sets, license_disposition, relation_adjacency, relation_summary, impact_discovery, consistency_notes, literal_differences,
        exact_identifier_match, freshness_join, affected_cases, section_neighbours, section_anchor, incremental_embedding_reuse, union_of_rows, required_sources_found, append_only_extension,
        evidence_dedup, family_components, family_split_leaks, hash_ordered_holdout, alternating_split,
    )
}

_PIECES = "pc AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, pos DESC) = 1)"
_SRC = "sr AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY version, language, document_key ORDER BY source_updated_at DESC, source_id DESC) = 1)"
_HASH = f"sha256({sql_squeeze('content')})"
_FAMILY = "translate(lower(trim(family_id)), '- ', '__')"
_KIND = "CASE WHEN o.f IS NULL THEN 'ADDED' WHEN n.f IS NULL THEN 'REMOVED' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'UNCHANGED' ELSE 'MODIFIED' END"


def sql_steps(path: str, step: str, order: str) -> str:
    """The rows r as old side o and new side n of every two consecutive steps (f, t) of a path."""
    return f"""s AS (SELECT {path}, {step} AS f, lead({step}) OVER (PARTITION BY {path} ORDER BY {order}) AS t FROM (SELECT DISTINCT {path}, {step} FROM r WHERE {step} IS NOT NULL) QUALIFY t IS NOT NULL),
o AS (SELECT r.*, f, t FROM r JOIN s ON r.{path} = s.{path} AND r.{step} = s.f), n AS (SELECT r.*, f, t FROM r JOIN s ON r.{path} = s.{path} AND r.{step} = s.t)"""


_SECTION_DIFF = f"""WITH {_PIECES},
r AS (SELECT document_key, split_part(chunk_id, ':', 2) AS lang, try_cast(regexp_extract(chunk_id, ':([0-9]+)$', 1) AS BIGINT) AS number, version, max({_HASH}) AS hash FROM pc GROUP BY 1, 2, 3, 4),
{sql_steps('document_key', 'version', "list_transform(regexp_extract_all(version, '[0-9]+'), lambda x: x::BIGINT), version")},
df AS (SELECT coalesce(o.document_key, n.document_key) AS document_key, coalesce(o.f, n.f) AS "from", coalesce(o.t, n.t) AS "to", coalesce(o.lang, n.lang) AS lang, coalesce(o.number, n.number) AS number, {_KIND} AS change_type
  FROM o FULL JOIN n ON o.document_key = n.document_key AND o.f = n.f AND o.t = n.t AND o.lang = n.lang AND o.number = n.number)"""
ITEM_ROWS = f"""r AS (SELECT project_id, snapshot_no, lower(trim(external_identifier)) AS identifier, title, {_HASH} AS hash FROM engineering_snapshots WHERE external_identifier IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY project_id, snapshot_no, lower(trim(external_identifier)) ORDER BY delivered_at DESC, {_HASH} DESC NULLS LAST, item_id DESC) = 1),
{sql_steps('project_id', 'snapshot_no', 'snapshot_no')}"""
ITEM_DIFF = f"""{ITEM_ROWS}, df AS (SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.f, n.f) AS "from", coalesce(o.t, n.t) AS "to", coalesce(o.identifier, n.identifier) AS identifier, {_KIND} AS change_type
  FROM o FULL JOIN n ON o.project_id = n.project_id AND o.f = n.f AND o.t = n.t AND o.identifier = n.identifier)"""
_NAMED = "list_distinct(regexp_extract_all({}, '[a-z]+\\.[a-z]+(?:_[a-z]+)+'))"

SQL = {
    "section_diff": _SECTION_DIFF + " SELECT * FROM df",
    "diff_summary": _SECTION_DIFF + " SELECT document_key, \"from\", \"to\", " + ", ".join(f"count(*) FILTER (change_type = '{k}') AS {k.lower()}" for k in ("ADDED", "REMOVED", "MODIFIED", "UNCHANGED")) + ", count(*) AS total FROM df GROUP BY 1, 2, 3",
    "item_diff": f"WITH {ITEM_DIFF} SELECT * FROM df",
    "recorded_change_summary": "SELECT project_id, change_type, count(*) AS n, count(DISTINCT lower(trim(external_identifier))) AS identifiers, max(recorded_at) AS last_recorded FROM item_changes GROUP BY 1, 2",
    "chunk_enrichment": f"WITH {_SRC} SELECT pos, source_id, coalesce(license_status, 'unknown') AS license_status, coalesce(publisher, 'unknown') AS publisher FROM chunks LEFT JOIN sr USING (version, language, document_key)".replace("SELECT pos, source_id, coalesce(license_status", "SELECT pos, source_id, coalesce(sr.license_status"),
    "chunks_without_source": "SELECT pos FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.version = c.version AND s.language = c.language AND s.document_key = c.document_key)",
    "duplicate_chunk_ids": "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1",
    "catalog_rows": f"WITH {_SRC} SELECT document_key, count(*) AS version_rows, count(DISTINCT version) AS versions, arg_max(version, row(source_updated_at, version, language)) AS active_version, array_to_string(list_sort(list(DISTINCT version)), ',') AS version_list FROM sr GROUP BY 1",
    "version_catalog_checks": """SELECT rule, count(*) AS violations, min(subject) AS first_subject FROM (
SELECT 'repeated source id' AS rule, source_id AS subject FROM sources GROUP BY source_id HAVING count(*) > 1
UNION ALL SELECT 'repeated document version', concat_ws(':', version, language, document_key) FROM sources GROUP BY version, language, document_key HAVING count(*) > 1
UNION ALL SELECT 'missing hash', source_id FROM sources WHERE sha256 IS NULL) GROUP BY 1""",
    "lineage_supersedes": f"WITH {_SRC}, n AS (SELECT document_key, language, version, concat_ws(':', version, language, document_key) AS node FROM sr) SELECT * FROM (SELECT node AS superseded, lead(node) OVER (PARTITION BY document_key, language ORDER BY version) AS superseding FROM n) WHERE superseding IS NOT NULL",
    "document_catalogue": "SELECT document_id, first(coalesce(document_title, heading) ORDER BY pos) AS title, count(*) AS chunks, count(DISTINCT heading) AS headings FROM chunks GROUP BY 1",
    "source_breakdown": "SELECT version, locale, source_type, license_status, count(*) AS rows, count(DISTINCT document_key) AS documents FROM sources GROUP BY 1, 2, 3, 4",
    "source_breakdown_sets": "SELECT version, language, count(*) AS rows FROM (SELECT coalesce(version, '-') AS version, coalesce(language, '-') AS language FROM sources) GROUP BY GROUPING SETS ((), (version), (language), (version, language))",
    "license_disposition": "SELECT upper(trim(coalesce(license, 'unknown'))) AS license, CASE WHEN lower(trim(coalesce(license_status, ''))) = '' THEN 'unknown' WHEN lower(license_status) LIKE '%review%' THEN 'reviewed' ELSE 'other' END AS disposition, count(*) AS rows FROM sources GROUP BY 1, 2",
    "relation_adjacency": """WITH e AS (SELECT DISTINCT case_id, derived_from FROM cases WHERE derived_from IS NOT NULL),
b AS (SELECT derived_from AS node, case_id AS neighbour, 'out' AS dir FROM e UNION ALL SELECT case_id, derived_from, 'in' FROM e)
SELECT node, count(*) FILTER (dir = 'out') AS outgoing, count(*) FILTER (dir = 'in') AS incoming, count(DISTINCT neighbour) AS neighbours FROM b GROUP BY 1""",
    "relation_summary": "SELECT derived_from IN (SELECT case_id FROM cases) AS parent_known, count(*) AS relations, count(DISTINCT derived_from) AS parents FROM (SELECT DISTINCT case_id, derived_from, family_id FROM cases) WHERE derived_from IS NOT NULL GROUP BY 1",
    "impact_discovery": f"""WITH o AS (SELECT case_id, max(derived_from) AS derived_from, max({_FAMILY}) AS family FROM cases GROUP BY 1),
l AS (SELECT derived_from AS item, case_id AS target FROM o WHERE derived_from IS NOT NULL),
s AS (SELECT DISTINCT i.item, k.case_id AS target FROM (SELECT DISTINCT item FROM l) i JOIN o a ON a.case_id = i.item JOIN o k ON k.family = a.family WHERE k.case_id <> i.item),
r AS (SELECT item, target, 'EXPLICIT' AS provenance, 'CONFIRMED' AS status, 0 AS priority FROM l UNION ALL SELECT item, target, 'RETRIEVAL_SUGGESTION', 'SUGGESTED', 1 FROM (SELECT item, target FROM s EXCEPT SELECT item, target FROM l))
SELECT provenance, status, priority, count(*) AS impacts, count(DISTINCT item) AS items, count(DISTINCT target) AS targets FROM r GROUP BY 1, 2, 3""",
    "consistency_notes": f"""WITH {_PIECES}, h AS (SELECT DISTINCT document_key, language, heading, version, {_HASH} AS hash FROM pc WHERE language IS NOT NULL AND heading IS NOT NULL AND content IS NOT NULL)
SELECT DISTINCT a.document_key, a.language, a.heading, a.version AS version_a, b.version AS version_b FROM h a JOIN h b ON a.document_key = b.document_key AND a.language = b.language AND a.heading = b.heading AND a.version < b.version AND a.hash <> b.hash""",
    "literal_differences": f"""WITH e AS (SELECT document_key, unnest(regexp_extract_all(content, '{_PARAMETER}', 1)) AS parameter, unnest(regexp_extract_all(content, '{_PARAMETER}', 2)) AS value FROM chunks WHERE content IS NOT NULL)
SELECT document_key, parameter, count(DISTINCT value) AS n_values, min(value) AS least, max(value) AS greatest FROM e GROUP BY 1, 2 HAVING count(DISTINCT value) >= 2""",
    "exact_identifier_match": f"""WITH a AS (SELECT pos, unnest({_NAMED.format('query')}) AS identifier FROM cases WHERE pos % 100 = 0 AND query IS NOT NULL), n AS (SELECT document_key, unnest({_NAMED.format('content')}) AS identifier FROM chunks WHERE content IS NOT NULL)
SELECT pos, identifier, count(*) AS chunks, count(DISTINCT document_key) AS documents FROM a JOIN n USING (identifier) GROUP BY 1, 2""",
    "freshness_join": f"""WITH {_SRC}, a AS (SELECT document_key, max(version) AS av FROM sr GROUP BY 1)
SELECT CASE WHEN c.version IS NULL OR av IS NULL THEN 'UNKNOWN' WHEN c.version = av THEN 'FRESH' ELSE 'STALE' END AS freshness, count(*) AS chunks, count(DISTINCT c.document_key) AS documents FROM chunks c LEFT JOIN a USING (document_key) GROUP BY 1""",
    "affected_cases": f"""WITH {_SRC}, a AS (SELECT document_key, max(version) AS av FROM sr GROUP BY 1), n AS (SELECT case_id, unnest(required_sources) AS source FROM cases)
SELECT case_id, count(DISTINCT source) AS stale_sources FROM n JOIN a ON a.document_key = split_part(source, ':', 3) WHERE split_part(source, ':', 1) <> av GROUP BY 1""",
    "section_neighbours": """WITH r AS (SELECT document_id, heading, pos, row_number() OVER (PARTITION BY document_id, heading ORDER BY pos) AS n FROM chunks)
SELECT a.pos AS "from", b.pos AS "to", (b.n - a.n)::INT AS distance FROM r a JOIN r b ON a.document_id = b.document_id AND a.heading IS NOT DISTINCT FROM b.heading AND a.n <> b.n AND abs(a.n - b.n) <= 2""",
    "section_anchor": "SELECT document_id, heading, min(pos) AS anchor, count(*) AS chunks FROM chunks GROUP BY 1, 2",
    "incremental_embedding_reuse": f"""WITH {_PIECES}, h AS (SELECT DISTINCT document_key, version, {_HASH} AS hash FROM pc WHERE content IS NOT NULL), n AS (SELECT document_key, max(version) AS newest FROM h GROUP BY 1),
t AS (SELECT h.*, newest FROM h JOIN n USING (document_key)), o AS (SELECT DISTINCT document_key, hash, 1 AS known FROM t WHERE version < newest)
SELECT document_key, count(known) AS reused, count(*) - count(known) AS missing FROM (SELECT DISTINCT document_key, hash FROM t WHERE version = newest) LEFT JOIN o USING (document_key, hash) GROUP BY 1""",
    "union_of_rows": "SELECT language, held_out, count(*) AS rows, sum(chars)::BIGINT AS chars FROM (SELECT language, false AS held_out, length(content) AS chars FROM chunks UNION ALL SELECT language, suite IS NOT NULL, length(passage) FROM eval_passages) GROUP BY 1, 2",
    "required_sources_found": "WITH n AS (SELECT DISTINCT case_id, unnest(required_sources) AS source FROM cases), h AS (SELECT DISTINCT document_id FROM chunks) SELECT case_id, count(document_id) AS found, count(*) - count(document_id) AS absent FROM n LEFT JOIN h ON h.document_id = n.source GROUP BY 1",
    "append_only_extension": f"""WITH r AS (SELECT snapshot_no, project_id, item_type, organization_id, document_id, section_id, external_identifier, title, content, content_hash, list_sort(map_entries(metadata)) AS metadata FROM engineering_snapshots), {sql_steps('project_id', 'snapshot_no', 'snapshot_no')}
SELECT project_id, f AS "from", t AS "to", count(*) AS lost_rows FROM (SELECT * EXCLUDE (snapshot_no) FROM o EXCEPT ALL SELECT * EXCLUDE (snapshot_no) FROM n) GROUP BY 1, 2, 3""",
    "evidence_dedup": f"SELECT min(pos) AS pos, document_key FROM chunks GROUP BY document_key, {_HASH}",
    "family_components": f"""WITH RECURSIVE e AS (SELECT 'case ' || case_id AS a, 'family ' || {_FAMILY} AS b FROM cases WHERE family_id IS NOT NULL UNION SELECT 'case ' || case_id, 'case ' || derived_from FROM cases WHERE derived_from IS NOT NULL),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.other),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)
SELECT root, count(*) FILTER (node LIKE 'case %') AS cases, count(*) FILTER (node LIKE 'family %') AS families FROM root GROUP BY 1""",
    "family_split_leaks": f"SELECT {_FAMILY} AS family, count(DISTINCT lower(trim(split))) AS splits, count(*) AS rows FROM cases WHERE family_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1",
    "hash_ordered_holdout": f"WITH f AS (SELECT DISTINCT {_FAMILY} AS family FROM cases WHERE family_id IS NOT NULL) SELECT family, CASE WHEN row_number() OVER (ORDER BY sha256('7|' || family), family) <= floor((SELECT count(*) FROM f) * 0.2 + 0.5) THEN 'holdout' ELSE 'dev' END AS side FROM f",
    "alternating_split": "SELECT case_id, category, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY sha256(case_id), case_id) % 2 = 1 THEN 'dev' ELSE 'holdout' END AS side FROM (SELECT DISTINCT case_id, coalesce(category, '-') AS category FROM cases)",
}
