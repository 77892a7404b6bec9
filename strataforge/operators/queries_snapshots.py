"""Queries of the snapshot comparison and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from . import snapshots

_COLUMNS = ("project_id", "snapshot_no", "external_identifier", "content", "delivered_at", "item_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    changes = snapshots.snapshot_changes(table(spark, d, "engineering_snapshots"), *_COLUMNS)
    return changes.select(F.col("project").alias("project_id"), F.col("key").alias("external_identifier"), "from_no", "to_no", "change_type")


def p2_item_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "engineering_snapshots")
    changes = snapshots.with_contents(snapshots.snapshot_changes(rows, *_COLUMNS), rows, *_COLUMNS)
    return changes.withColumnRenamed("project", "project_id").withColumnRenamed("key", "external_identifier").select(
        "project_id", "external_identifier", "from_no", "to_no", "change_type", "old_item_id", "new_item_id", "old_content", "new_content"
    )


QUERIES = {"p2_found": p2_found, "p2_item_changes": p2_item_changes}
SQL: dict[str, str] = {}
