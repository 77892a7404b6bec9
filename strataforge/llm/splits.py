"""Problem 5: splits that keep related records together.

Records are tied by their family (letter case, outer blanks and the choice of `-`, `_` or blank do not matter) and by the record they
are derived from. Groups are the components of these ties, by union-find forests of the partitions merged level by level.
Groups are then assigned largest first, each to the split furthest below its target. As groups of one size are alike, only
the number of groups of each size goes to the driver (at most sqrt(2 x records) sizes), the greedy choice is replayed there
on whole runs of equal groups, and each group finds its split by its rank within its size.

Defined cases: rows without id are left out, repeated rows of an id are one record with all their ties; an empty family is no family; a parent that is no
record ties nothing; all records are assigned anew, whatever split they had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.ordering import running_total
from ..plans.tables import written


def split_name(column: str):
    return F.lower(F.trim(F.regexp_replace(F.col(column), "^\\s+|\\s+$", "")))


def related_groups(df: DataFrame, row_id: str, family: str, parent: str) -> DataFrame:
    """(id, group_id): every record with the smallest id of its group, itself if it has no relatives."""
    rows = df.select(F.col(row_id).alias("id"), F.translate(F.lower(F.regexp_replace(F.col(family), "^\\s+|\\s+$", "")), "- ", "__").alias("family"), F.col(parent).alias("parent")).where("id is not null")
    ids = written(rows.select("id").distinct())
    families = rows.where("family <> ''").select(F.concat(F.lit("f "), "family").alias("a"), F.concat(F.lit("r "), "id").alias("b"))
    parents = rows.where("parent is not null").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")
    parents = parents.select(F.concat(F.lit("r "), "parent").alias("a"), F.concat(F.lit("r "), "id").alias("b"))
    roots = connected_components(families.union(parents))
    members = written(roots.where("node like 'r %'").select(F.substring("node", 3, 1 << 30).alias("id"), "root"))
    least = members.groupBy("root").agg(F.min("id").alias("group_id"))
    placed = members.join(least, "root").select("id", "group_id")
    return ids.join(placed, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def greedy_counts(sizes: list[tuple[int, int]], targets: list[tuple[str, float]]) -> dict[int, list[int]]:
    """How many groups of each size every split gets when groups come largest first and each goes to the split furthest below target (ties: the first).

    While groups of one size are dealt, the k-th group of a split is dealt at its shortfall less k sizes; dealing `many` groups
    one by one takes the `many` greatest of these values. All above a level found by bisection are taken at once.
    """
    total = sum(s * m for s, m in sizes)
    short = [total * share for _, share in targets]
    out = {}
    for size, many in sorted(sizes, reverse=True):
        counts = [0] * len(targets)
        if many > 64:
            low, high = max(short) - (many + 1) * size, max(short) + 1
            for _ in range(100):
                level = (low + high) / 2
                if sum(int((d - level) // size) + 1 for d in short if d >= level) > many:
                    low = level
                else:
                    high = level
            counts = [int((d - high) // size) + 1 if d >= high else 0 for d in short]
            short = [d - k * size for d, k in zip(short, counts)]
        for _ in range(many - sum(counts)):
            i = max(range(len(targets)), key=lambda k: (short[k], -k))
            counts[i] += 1
            short[i] -= size
        out[size] = counts
    return out


def assign_splits(groups: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """(id, group_id, split) from (id, group_id) and the wanted shares (three or so, given in order)."""
    sizes = written(groups.groupBy("group_id").agg(F.count("*").alias("size")))
    counts = greedy_counts([(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()], targets)
    ranked = running_total(sizes.withColumn("one", F.lit(1).cast("bigint")), ["group_id"], "one", "rank", by="size")
    bounds = []
    for size in counts:
        before = 0
        for (name, _), k in zip(targets, counts[size]):
            if k:
                bounds.append((size, before + 1, before + k, name))
                before += k
    # One row for each size and split, at most 3 sqrt(2 x records); joined on the size, so the engine may hash it whatever its size.
    table = groups.sparkSession.createDataFrame(bounds, "size bigint, low bigint, high bigint, split string")
    placed = ranked.join(table, "size").where(F.col("rank").between(F.col("low"), F.col("high"))).select("group_id", "split")
    return groups.join(placed, "group_id").select("id", "group_id", "split")


def conflicting_groups(df: DataFrame, groups: DataFrame, row_id: str, split: str) -> DataFrame:
    """(group_id, id): all records of the groups whose stored splits are more than one."""
    stored = df.select(F.col(row_id).alias("id"), split_name(split).alias("split")).where("split <> ''").distinct()
    mixed = groups.join(stored, "id").groupBy("group_id").agg(F.min("split").alias("x"), F.max("split").alias("y")).where("x <> y").select("group_id")
    return groups.join(mixed, "group_id").select("group_id", "id")
