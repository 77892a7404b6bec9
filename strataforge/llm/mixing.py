"""Problem 8: mixing sources to target weights.

Weighted fair queueing. The documents of a source are shuffled by a keyed hash; each gets a virtual finish time, the tokens of its
source up to and with it divided by the source's weight; a repeat goes on where the round before ended. Over all sources the
documents are sorted by finish time and taken up to the total budget, the last one where it comes nearer to the budget
than leaving it out. Without a given budget it is the largest for which no source must exceed its repeats, so that all reach
their shares; a greater budget takes all repeats of the sources that run out.

Tokens are those of a public tokenizer (a byte-pair vocabulary of ranks; its path is a parameter). Defined cases: sources are compared by
lower case, trimmed, `-` and blanks as `_`; documents without id, text or a wanted source are left out, empty texts have
no tokens and come with their neighbours; targets with no documents reach 0; targets without positive share or repeats are not drawn.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_total
from ..plans.tables import written


@lru_cache(maxsize=2)
def encoder(path: str | None):
    """The tokenizer of a file of ranks, the default being the public one for many languages."""
    import tiktoken
    from public_tokenizers import PATTERN, path as place

    with open(path or place("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_name(column: str):
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(column), "^\\s+|\\s+$", "")), "[-\\s]", "_")


def token_counts(df: DataFrame, row_id: str, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """(id, kept columns, tokens)."""
    rows = df.select(F.col(row_id).alias("id"), *keep, F.col(text).alias("text")).where("id is not null and text is not null")
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for batch in batches:
            counts = [len(tokenizer.encode_ordinary(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return rows.mapInArrow(run, f"{head}, tokens bigint")


def mixture(df: DataFrame, targets: DataFrame, row_id: str, text: str, source: str, budget: int | None = None, seed: str = "mix", path: str | None = None) -> DataFrame:
    """(id, source, repeat_no, tokens, finish): the drawn documents, range-sorted by finish time.

    `targets` (source, target_share, max_repeats) is a small fixed table of distinct sources; it is read to the driver.
    """
    wanted = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").collect()]
    weights = df.sparkSession.createDataFrame(wanted, "source string, weight double, repeats int")
    rows = df.withColumn("_source", source_name(source)).join(F.broadcast(weights), F.col("_source") == weights["source"], "left_semi")
    # Written before the range sort, whose sampling would count all tokens a second time.
    counted = token_counts(rows.withColumnRenamed("_source", "_name").drop("source").withColumnRenamed("_name", "source"), row_id, text, ["source"], path)
    counted = written(counted).withColumn("place", F.xxhash64(F.lit(seed), F.col("id").cast("string")))
    lined = running_total(counted, ["place", "id"], "tokens", "upto", by="source")
    sums = {r["source"]: r["t"] for r in lined.groupBy("source").agg(F.sum("tokens").alias("t")).collect() if r["t"]}
    able = [(sums[s] * k, w) for s, w, k in wanted if s in sums]
    if budget is None:
        budget = int(min((have / w for have, w in able), default=0) * sum(w for _, w in able))
    level = _level(able, budget)
    weights = weights.join(df.sparkSession.createDataFrame([(s, t) for s, t in sums.items()], "source string, whole bigint"), "source")
    rounds = lined.join(F.broadcast(weights), "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    timed = rounds.withColumn("finish", ((F.col("repeat_no") - 1) * F.col("whole") + F.col("upto")) / F.col("weight"))
    near = timed.where(F.col("finish") - F.col("tokens") / F.col("weight") <= level).select("id", "source", "repeat_no", "tokens", "finish")
    ordered = running_total(near, ["finish", "id", "repeat_no"], "tokens", "_total")
    return ordered.where(F.col("_total") - F.col("tokens") / 2 <= budget).drop("_total")


def _level(able: list[tuple[int, float]], budget: int) -> float:
    """The finish time at which the sources together have given the budget."""
    left, level = float(budget), 0.0
    open_ = sorted(able, key=lambda x: x[0] / x[1])
    while open_ and left > 0:
        end, rate = open_[0][0] / open_[0][1], sum(w for _, w in open_)
        if (end - level) * rate >= left:
            return level + left / rate
        left -= (end - level) * rate
        level = end
        open_ = open_[1:]
    return level


def reached_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, draws, documents, most_repeats) for every target."""
    own = drawn.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("draws"), F.countDistinct("id").alias("documents"), F.max("repeat_no").alias("most_repeats"))
    all_tokens = own.agg(F.sum("tokens").alias("_all"))
    out = targets.select(source_name("source").alias("source"), "target_share").join(own, "source", "left").crossJoin(F.broadcast(all_tokens))  # one row
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "draws", "documents", "most_repeats")]
    return out.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"), *zero)
