"""The queries of the operators in this folder and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from . import canonical as _canonical
from . import leakage as _leakage
from . import mixing as _mixing
from . import near_duplicates as _near
from . import overlaps as _overlaps
from . import pieces as _pieces
from . import sentences as _sentences
from . import splits as _splits


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, column in (("chunks", "content"), ("cases", "query")):
        pairs = _canonical.look_alike_pairs(table(spark, d, name), "pos", column)
        parts.append(pairs.select(F.lit(name).alias("table_name"), F.col("id_a").alias("pos_a"), F.col("id_b").alias("pos_b")))
    return parts[0].union(parts[1])


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row that looks like a differently stored one, with its class, spelling and their sizes."""
    parts = [
        _canonical.look_alike_classes(table(spark, d, name), "pos", column).select(
            F.lit(name).alias("table_name"), F.col("id").alias("pos"), F.col("class_id").alias("class_pos"), F.col("spelling_id").alias("spelling_pos"), "class_rows", "spellings"
        )
        for name, column in (("chunks", "content"), ("cases", "query"))
    ]
    return parts[0].union(parts[1])


def p1_chunk_forms(spark: SparkSession, d: str) -> DataFrame:
    return _canonical.with_canonical(table(spark, d, "chunks").select("pos", "content"), "content").drop("content")


def p1_case_forms(spark: SparkSession, d: str) -> DataFrame:
    return _canonical.with_canonical(table(spark, d, "cases").select("pos", "query"), "query").drop("query")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = _near.near_duplicate_groups(table(spark, d, "chunks"), "pos", "content")
    return groups.where("id <> group_id").select(F.col("group_id").alias("group_pos"), F.col("id").alias("pos"))


def p3_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps.cross_split_overlaps(table(spark, d, "cases"), "case_id", "summary", "split", "recorded_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The overlapping pairs, the smaller id first, whichever side it is on."""
    return p3_overlaps(spark, d).select(F.least("id_a", "id_b").alias("case_id_a"), F.greatest("id_a", "id_b").alias("case_id_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation cases that overlap with training, by their split and suite."""
    cases = table(spark, d, "cases").groupBy("case_id").agg(F.max(F.struct("recorded_at", "summary", "split", "suite")).alias("r"))
    cases = cases.select(F.col("case_id").alias("id_b"), F.lower(F.trim("r.split")).alias("split"), "r.suite")
    pairs = p3_overlaps(spark, d).select("id_a", "id_b").join(cases, "id_b")
    return pairs.groupBy("split", "suite").agg(F.count("*").alias("pairs"), F.countDistinct("id_b").alias("eval_cases"), F.countDistinct("id_a").alias("train_cases"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = _pieces.cut_oversized(table(spark, d, "chunks"), "pos", "content", "heading_path")
    return pieces.withColumnRenamed("id", "pos")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where("piece_no = 1").select("pos")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_passages")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return _splits.related_groups(table(spark, d, "cases"), "case_id", "family_id", "derived_from")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _splits.conflicting_groups(table(spark, d, "cases"), _groups(spark, d), "case_id", "split")
    return rows.select(F.col("group_id").alias("group_case_id"), F.col("id").alias("case_id"))


def _targets(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    return [(r["split"], r["target_share"]) for r in table(spark, d, "split_targets").orderBy(F.desc("target_share"), "split").collect()]


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return _splits.assign_splits(_groups(spark, d), _targets(spark, d)).withColumnRenamed("id", "case_id").withColumnRenamed("group_id", "group_case_id")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Cases and reached share of each split."""
    own = p5_splits(spark, d).groupBy("split").agg(F.count("*").alias("cases"), F.countDistinct("group_case_id").alias("groups"))
    whole = own.agg(F.sum("cases").alias("n"))
    targets = table(spark, d, "split_targets").join(own, "split", "left").crossJoin(F.broadcast(whole))  # one row
    return targets.select("split", "target_share", (F.coalesce("cases", F.lit(0)) / F.col("n")).alias("actual_share"), F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("groups", F.lit(0)).alias("groups"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    drawn = _mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source")
    return drawn.withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return _mixing.reached_shares(_mixing.mixture(table(spark, d, "documents"), targets, "doc_id", "text", "source"), targets)


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _sentences.sentences(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_sentences(spark, d).select("doc_id", "start_char", "end_char")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_classes, p1_chunk_forms, p1_case_forms, p3_found, p3_overlaps, p3_report, p4_found, p5_found, p5_splits, p5_shares,
        p6_found, p6_pieces, p7_found, p7_leaks, p8_mixture, p8_shares, p9_found, p9_sentences,
    )
}
SQL: dict[str, str] = {
    "p5_found": """WITH RECURSIVE c AS (SELECT case_id, nullif(translate(lower(regexp_replace(family_id, '^\\s+|\\s+$', '', 'g')), '- ', '__'), '') AS family, derived_from, nullif(lower(trim(split)), '') AS split FROM cases WHERE case_id IS NOT NULL),
e AS (SELECT 'r ' || case_id AS a, 'f ' || family AS b FROM c WHERE family IS NOT NULL UNION SELECT 'r ' || case_id, 'r ' || derived_from FROM c WHERE derived_from IN (SELECT case_id FROM c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.other),
g AS (SELECT substr(node, 3) AS case_id, min(substr(other, 3)) FILTER (other LIKE 'r %') AS group_case_id FROM reach WHERE node LIKE 'r %' GROUP BY 1),
m AS (SELECT group_case_id FROM g JOIN c USING (case_id) GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT group_case_id, case_id FROM g WHERE group_case_id IN (SELECT group_case_id FROM m)""",
    "p6_found": "SELECT pos FROM chunks WHERE length(content) > 1250",
}
