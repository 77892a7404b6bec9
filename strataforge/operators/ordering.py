"""Running totals over a globally sorted table, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..plans.tables import written


def running_total(df: DataFrame, order: list[str], value: str, out: str, by: str | None = None) -> DataFrame:
    """`df` with the sum of `value` over all rows up to each in `order` (inclusive), within each `by` if given.

    Rows are range-partitioned and sorted; each partition sums its own rows, and the sums of the partitions before are
    added from a table of one row for each partition and key in it (partitions + keys rows at most, so it is broadcast).
    Equal rows are ordered arbitrarily but consistently. Nulls in `value` count 0. Integers stay exact.
    """
    keys = ([by] if by else []) + order
    real = isinstance(df.schema[value].dataType, DoubleType)
    kind = DoubleType() if real else LongType()
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    schema = StructType([*rows.schema.fields, StructField(out, kind)])
    at = rows.columns.index(value)
    key_at = rows.columns.index(by) if by else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            v = np.nan_to_num(np.asarray(batch.column(at).fill_null(0)).astype(np.float64 if real else np.int64))
            cum = np.cumsum(v)
            if key_at is None:
                cum = cum + total
                total = cum[-1] if len(cum) else total
            elif len(cum):
                names = batch.column(key_at).to_pylist()
                first = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
                base = np.zeros(len(cum), cum.dtype)
                for k, i in enumerate(first):
                    before = cum[i - 1] if i else 0
                    base[i : first[k + 1] if k + 1 < len(first) else len(cum)] = before - (total if i == 0 and names[0] == last else 0)
                cum = cum - base
                last, total = names[-1], cum[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cum)], names=[*batch.schema.names, out])

    rows = written(rows.mapInArrow(run, schema))
    parts = rows.groupBy("_part", *([by] if by else [])).agg(F.sum(F.coalesce(value, F.lit(0))).alias("_sum"))
    w = Window.orderBy("_part") if not by else Window.partitionBy(by).orderBy("_part")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    on = ["_part"] + ([by] if by else [])
    return rows.join(F.broadcast(parts), on).withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")
