"""Connected components of an edge table: local union-find forests, merged level by level.

Every level runs a union-find inside each partition and keeps only the forest (at most one edge per
node and partition), partitioned anew by the larger end. The last merge in one task is taken only
while the forest has at most `merge_rows` edges; above that bound the forest is contracted by
star rounds (every node and its neighbours hooked to the smallest neighbour) until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}
    kind = None

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        kind = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                low, high = (ra, rb) if ra < rb else (rb, ra)
                parent[high] = low
                parent.setdefault(low, low)
    if kind is None:
        return
    nodes = [x for x in parent if root(x) != x]
    step = 65536
    for i in range(0, len(nodes), step):
        part = nodes[i : i + step]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, kind.field(0).type), pa.array([parent[x] for x in part], kind.field(1).type)], names=["node", "root"]
        )


def _forest(edges: DataFrame) -> DataFrame:
    kind = edges.schema["node"].dataType.simpleString()
    return edges.select("node", "root").mapInArrow(_local_forest, f"node {kind}, root {kind}")


def _star_round(forest: DataFrame) -> DataFrame:
    """Large star, then small star, each as one minimum aggregation and a join."""
    both = forest.union(forest.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("m", "node").alias("m"))
    large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root"))
    large = large.where("node <> root").distinct()
    low = large.groupBy("node").agg(F.min("root").alias("m"))
    small = large.join(low, "node").select(F.col("root").alias("node"), F.col("m").alias("root"))
    return small.where("node <> root").union(low.select("node", F.col("m").alias("root"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", merge_rows: int = 1_000_000, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component.

    Null ends and loops are left out; nodes named by no edge have no row. `merge_rows` bounds what one task
    ever merges (150 to 250 bytes an edge); it changes the way, not the result.
    """
    spark = edges.sparkSession
    clean = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where(f"{a} is not null and {b} is not null and {a} <> {b}")
    forest = written(_forest(clean))
    rows = forest.count()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while rows > merge_rows and parts > 8:
        parts //= 4
        merged = written(_forest(forest.repartition(parts * 4, "node")))
        now = merged.count()
        if now > 0.7 * rows:
            forest = merged
            break
        forest, rows = merged, now
    if rows <= merge_rows:
        merged = written(_forest(forest.coalesce(1)))
        return merged.union(_roots(merged))
    last = None
    for _ in range(max_rounds):
        forest = written(_star_round(forest))
        now = forest.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == last:
            return forest.union(_roots(forest))
        last = now
    raise RuntimeError("components did not settle")


def _roots(forest: DataFrame) -> DataFrame:
    return forest.select(F.col("root").alias("node"), "root").distinct()
