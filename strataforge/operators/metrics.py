"""Ranking-quality metrics with their conventions as parameters, and sample statistics.

`mrr`: first (1 / first relevant rank) or sum (sum of 1 / rank over wanted sources, divided by their number).
`ndcg`: source_once (a source gains at its first rank), distinct (ranks counted over distinct sources), chunk (every relevant row gains).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def per_query(hits: DataFrame, truth: DataFrame, k: int = 5, mrr: str = "first", ndcg: str = "source_once") -> DataFrame:
    """(query_id, wanted, hit_at_1, hit_at_k, recall, complete, rr, ndcg) for every query of `truth` (query_id, source); hits are (query_id, rank, source)."""
    wanted = truth.distinct().groupBy("query_id").agg(F.count("*").alias("wanted"))
    rows = hits
    if ndcg == "distinct":
        first = hits.groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
        rows = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    relevant = rows.where(F.col("rank") <= k).join(truth.distinct(), ["query_id", "source"])
    sources = relevant.groupBy("query_id", "source").agg(F.min("rank").alias("rank"), F.sum(_gain(F.col("rank"))).alias("all_gain"))
    gain = F.sum("all_gain") if ndcg == "chunk" else F.sum(_gain(F.col("rank")))
    found = sources.groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1.0 / F.col("rank")).alias("inverse"), gain.alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + _gain(i))
    rr = F.coalesce(1.0 / F.col("first"), F.lit(0.0)) if mrr == "first" else F.coalesce(F.col("inverse") / F.col("wanted"), F.lit(0.0))
    out = wanted.join(found, "query_id", "left")
    return out.select(
        "query_id", "wanted", F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("hit_at_1"), F.when(F.col("found") > 0, 1).otherwise(0).alias("hit_at_k"),
        (F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("recall"), F.when(F.col("found") == F.col("wanted"), 1).otherwise(0).alias("complete"), F.coalesce("found", F.lit(0)).alias("found"),
        rr.alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Averages over the queries, macro and micro recall; with `by`, over all and over each column's values (GROUPING SETS)."""
    aggregates = [
        F.count("*").alias("queries"), F.round(F.avg("hit_at_1"), 6).alias("hit_at_1"), F.round(F.avg("hit_at_k"), 6).alias("hit_at_k"), F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.round(F.sum("found") / F.sum("wanted"), 6).alias("micro_recall"), F.round(F.avg("complete"), 6).alias("complete"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"),
    ]
    if not by:
        return rows.agg(*aggregates)
    return rows.groupingSets([[], *([c] for c in by)], *by).agg(*aggregates)


def sample_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, linear and nearest-rank percentiles, extremes and population deviation."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 4).alias("p50"), F.round(F.percentile(v, F.lit(0.9)), 4).alias("p90"), F.round(F.percentile(v, F.lit(0.95)), 4).alias("p95"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95_nearest"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.round(F.stddev_pop(v), 4).alias("deviation"),
    )
