"""Problem 2: what changed between consecutive full snapshots.

The rows of all snapshots of a project are range-partitioned and sorted by key together. The sorted keys are cut into
content-defined chunks: a chunk begins at every key whose own hash says so (one in `mean`), and where a range begins; the cuts
of a key range are the same for all its snapshots, however many rows come or go between. A chunk's digest sums its rows'
digests. Chunks whose digest is that of the next snapshot are discarded; rows of the others are joined and classified.

Only digests travel until the changes are known; contents are joined to the changed rows at the end.

Defined cases: of repeated rows of a key in a snapshot the latest delivery holds (ties: the greatest content, then id; a null
time is the earliest); keys are lower-cased and trimmed, rows without project, number or key are left out; null content is
a value of its own; consecutive numbers are those that exist for the project; a project with one snapshot has no changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import squeezed
from ..plans.tables import written


def _digest_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest of the normalised content; the content itself stays behind."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("content")).to_pylist()
        digests = [xxhash.xxh3_64_intdigest(squeezed(t)) - (1 << 63) if t is not None else 0 for t in texts]
        rest = [i for i, n in enumerate(batch.schema.names) if n != "content"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(digests, pa.int64())], names=[*(batch.schema.names[i] for i in rest), "digest"])


def _chunk_pass(mean: int):
    """Adds to sorted rows the name of their chunk: the hash of the key it begins at, 0 where a range or a project begins.

    A name depends on the boundary key alone, so the digests of a delivery can be kept and held against a later one's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk = (None, None), 0
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for i, (project, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if (project, key) != last:
                    named = xxhash.xxh3_64_intdigest(key)
                    if named % mean == 0:
                        chunk = named - (1 << 63)
                    elif project != last[0]:
                        chunk = 0
                    last = (project, key)
                out[i] = chunk
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "chunk"])

    return run


def latest_rows(df: DataFrame, project: str, number: str, key: str, content: str, time: str, row_id: str) -> DataFrame:
    """(project, no, key, own, digest): one row for each key of a snapshot; `own` says which of its deliveries it is."""
    rows = df.select(
        F.col(project).alias("project"), F.col(number).alias("no"), F.lower(F.trim(F.regexp_replace(F.col(key), "^\\s+|\\s+$", ""))).alias("key"),
        F.struct(F.col(time).alias("t"), F.xxhash64(content).alias("c"), F.col(row_id).alias("i")).alias("own"), F.col(content).alias("content"),
    ).where("project is not null and no is not null and key is not null")
    kind = rows.schema["own"].dataType.simpleString()
    head = f"project {rows.schema['project'].dataType.simpleString()}, no {rows.schema['no'].dataType.simpleString()}, key string"
    digests = rows.mapInArrow(_digest_pass, f"{head}, own {kind}, digest bigint")
    return digests.groupBy("project", "no", "key").agg(F.max(F.struct("own", "digest")).alias("r")).select("project", "no", "key", "r.own", "r.digest")


def following(numbers: DataFrame, project: str, number: str) -> DataFrame:
    """(project, from_no, to_no): each number of a project with the next one there is; `numbers` has a row a snapshot, not an item."""
    ahead = F.lead(number).over(Window.partitionBy(project).orderBy(number))
    return numbers.select(F.col(project).alias("project"), F.col(number).alias("from_no"), ahead.alias("to_no")).where("to_no is not null")


def snapshot_changes(df: DataFrame, project: str, number: str, key: str, content: str, time: str, row_id: str, mean: int = 64) -> DataFrame:
    """(project, key, from_no, to_no, change_type, old_own, new_own): ADDED, REMOVED and MODIFIED rows."""
    rows = latest_rows(df, project, number, key, content, time, row_id)
    p, n = rows.schema["project"].dataType.simpleString(), rows.schema["no"].dataType.simpleString()
    own = rows.schema["own"].dataType.simpleString()
    sorted_rows = rows.select("project", "no", "key", "own", "digest").repartitionByRange("project", "key").sortWithinPartitions("project", "key", "no")
    chunked = written(
        sorted_rows.mapInArrow(_chunk_pass(mean), f"project {p}, no {n}, key string, own {own}, digest bigint, chunk bigint")
        .withColumn("part", F.spark_partition_id())
        .withColumn("row", F.xxhash64("key", "digest"))
    )
    steps = following(chunked.select("project", "no").distinct(), "project", "no")
    sums = chunked.groupBy("project", "no", "part", "chunk").agg(F.count("*").alias("k"), F.sum(F.col("row").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.col("row"), F.lit(1))).alias("x"))
    step_sums = sums.join(steps.withColumnRenamed("from_no", "no"), ["project", "no"]).withColumnRenamed("no", "from_no")
    next_sums = sums.select(F.col("project"), F.col("no").alias("to_no"), "part", "chunk", F.col("k").alias("k2"), F.col("s").alias("s2"), F.col("x").alias("x2")).join(steps, ["project", "to_no"])
    where = ["project", "from_no", "to_no", "part", "chunk"]
    open_chunks = step_sums.join(next_sums, where, "full_outer").where("not (k <=> k2 and s <=> s2 and x <=> x2)").select(*where)
    old = open_chunks.join(chunked.withColumnRenamed("no", "from_no"), ["project", "from_no", "part", "chunk"]).select(*where, "key", F.col("own").alias("old_own"), F.col("digest").alias("d1"))
    new = open_chunks.join(chunked.withColumnRenamed("no", "to_no"), ["project", "to_no", "part", "chunk"]).select(*where, "key", F.col("own").alias("new_own"), F.col("digest").alias("d2"))
    kind = F.when(F.col("d1").isNull(), "ADDED").when(F.col("d2").isNull(), "REMOVED").when(F.col("d1") != F.col("d2"), "MODIFIED")
    changes = old.join(new, [*where, "key"], "full_outer").withColumn("change_type", kind).where("change_type is not null")
    return changes.select("project", "key", "from_no", "to_no", "change_type", "old_own", "new_own")


def with_contents(changes: DataFrame, df: DataFrame, project: str, number: str, key: str, content: str, time: str, row_id: str) -> DataFrame:
    """The changes with item ids and contents of both sides, as stored."""
    rows = df.select(
        F.col(project).alias("project"), F.col(number).alias("no"), F.lower(F.trim(F.regexp_replace(F.col(key), "^\\s+|\\s+$", ""))).alias("key"),
        F.struct(F.col(time).alias("t"), F.xxhash64(content).alias("c"), F.col(row_id).alias("i")).alias("own"), F.col(content).alias("content"),
    )
    wanted = changes.select("project", F.col("from_no").alias("no"), "key", F.col("old_own").alias("own")).where("own is not null")
    wanted = wanted.union(changes.select("project", F.col("to_no").alias("no"), "key", F.col("new_own").alias("own")).where("own is not null")).distinct()
    on = rows.alias("r").join(wanted.alias("w"), [F.col("r.project") == F.col("w.project"), F.col("r.no") == F.col("w.no"), F.col("r.key") == F.col("w.key"), F.col("r.own").eqNullSafe(F.col("w.own"))])
    found = on.groupBy("r.project", "r.no", "r.key").agg(F.max("r.content").alias("content"), F.max("r.own.i").alias("item"))
    old = found.select("project", F.col("no").alias("from_no"), "key", F.col("content").alias("old_content"), F.col("item").alias("old_item_id"))
    new = found.select("project", F.col("no").alias("to_no"), "key", F.col("content").alias("new_content"), F.col("item").alias("new_item_id"))
    out = changes.drop("old_own", "new_own").join(old, ["project", "from_no", "key"], "left").join(new, ["project", "to_no", "key"], "left")
    return out.withColumn("old_content", F.when(F.col("change_type") != "ADDED", F.col("old_content"))).withColumn("new_content", F.when(F.col("change_type") != "REMOVED", F.col("new_content")))
