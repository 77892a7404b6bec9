"""Versions, diffs, catalogues, relations and evidence of versioned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison on `keys`: ADDED, REMOVED, MODIFIED or UNCHANGED with both values; keys are unique on each side."""
    o, n = old.select(*keys, F.col(value).alias("old_value"), F.lit(1).alias("_o")), new.select(*keys, F.col(value).alias("new_value"), F.lit(1).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "ADDED").when(F.col("_n").isNull(), "REMOVED").when(F.col("old_value").eqNullSafe(F.col("new_value")), "UNCHANGED").otherwise("MODIFIED")
    return o.join(n, keys, "full_outer").withColumn("change_type", kind).drop("_o", "_n")


def stepped(df: DataFrame, path: list[str], step: str, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """`df` as the old and as the new side of every two consecutive existing steps of a path, with the columns from and to."""
    steps = df.where(F.col(step).isNotNull()).select(*path, step).distinct()
    w = Window.partitionBy(*path).orderBy(*([order] if order is not None else []), step)
    steps = steps.select(*path, F.col(step).alias("from"), F.lead(step).over(w).alias("to")).where("to is not null")
    return df.join(steps.withColumn(step, F.col("from")), [*path, step]).drop(step), df.join(steps.withColumn(step, F.col("to")), [*path, step]).drop(step)


def diff_summary(diff: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the four classes, zero where there are none."""
    return diff.groupBy(*by).agg(*(F.count_if(F.col("change_type") == k).alias(k.lower()) for k in ("ADDED", "REMOVED", "MODIFIED", "UNCHANGED")), F.count("*").alias("total"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a uniqueness rule: keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unmatched(df: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of referential integrity: rows without a parent."""
    return df.join(parents.select(*keys).distinct(), keys, "left_anti")


def lineage(df: DataFrame, path: list[str], version: str, node: str) -> DataFrame:
    """Consecutive releases along a path: (old, new) `supersedes` edges."""
    w = Window.partitionBy(*path).orderBy(version)
    return df.select(F.col(node).alias("superseded"), F.lead(node).over(w).alias("superseding")).where("superseding is not null")


def adjacency(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, neighbour, direction): every edge from either end."""
    out = edges.select(F.col(source).alias("node"), F.col(target).alias("neighbour"), F.lit("out").alias("direction"))
    return out.union(edges.select(F.col(target), F.col(source), F.lit("in"))).where("node is not null and neighbour is not null")


def impacts(changed: DataFrame, links: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(item, target, provenance, status, priority): confirmed links first, then suggestions whose target no link names."""
    explicit = changed.join(links, "item").select("item", "target", F.lit("EXPLICIT").alias("provenance"), F.lit("CONFIRMED").alias("status"), F.lit(0).alias("priority"))
    found = changed.join(suggestions, "item").join(explicit.select("item", "target").distinct(), ["item", "target"], "left_anti").where("item <> target")
    return explicit.union(found.select("item", "target", F.lit("RETRIEVAL_SUGGESTION"), F.lit("SUGGESTED"), F.lit(1)).distinct())


def freshness(evidence: DataFrame, active: DataFrame) -> DataFrame:
    """Adds `freshness`: HISTORICAL scope is fresh, unknown ids are unknown, the active version is fresh, any other stale."""
    rows = evidence.join(active, "document", "left")
    state = (
        F.when(F.col("historical"), "FRESH").when(F.col("version").isNull() | F.col("active_version").isNull(), "UNKNOWN")
        .when(F.col("version") == F.col("active_version"), "FRESH").otherwise("STALE")
    )
    return rows.withColumn("freshness", state)


def neighbours(df: DataFrame, keys: list[str], order: str, reach: int = 1) -> DataFrame:
    """(from, to, distance) of positions up to `reach` apart within each key, by offset windows, not a self-join."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_to", F.array(*(F.struct(F.lit(k).alias("distance"), (F.lag(order, -k) if k < 0 else F.lead(order, k)).over(w).alias("to")) for k in range(-reach, reach + 1) if k)))
    rows = rows.select(F.col(order).alias("from"), F.explode("_to").alias("n")).select("from", "n.to", "n.distance")
    return rows.where("to is not null")


def differing_versions(df: DataFrame, keys: list[str], version: str, value: str) -> DataFrame:
    """(keys, version_a, version_b): pairs of versions of a key whose values differ.

    Values are first reduced to their least and greatest hash for each version, so a key with very many rows costs one row for each version.
    """
    own = df.where(F.col(value).isNotNull() & F.col(version).isNotNull()).groupBy(*keys, version).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    a, b = own.withColumnsRenamed({version: "version_a", "lo": "lo_a", "hi": "hi_a"}), own.withColumnsRenamed({version: "version_b", "lo": "lo_b", "hi": "hi_b"})
    pairs = a.join(b, keys).where("version_a < version_b and not (lo_a = hi_a and lo_b = hi_b and lo_a = lo_b)")
    return pairs.select(*keys, "version_a", "version_b")
