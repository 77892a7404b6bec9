"""Problem 3: records of evaluation splits that stand, exactly or almost, in the training split.

The similarity is one of token sets, so every record's text is laid out as its distinct tokens in one order for all records, rare tokens
first: whatever order, repetition or place of edits the records had, what two of them share are then spans of these texts.
The texts of all records make up a suffix array, partitioned by first token and sorted within each partition by the tokens
that follow. Suffixes with the same first token form an interval; its suffixes of both splits with a common prefix show a span
the two records share, taken where it starts (the tokens before it differ). Spans are merged along the two
texts into the share of each record they cover, and the similarity follows from these shares.

No span length is asked for and nothing is left out for being frequent. Two sets of n and m tokens with similarity t or more share
t / (1 + t) (n + m) tokens, so their first shared span starts within the first n - ceil(t n) + 1 tokens of either: only
suffixes from there are built. Tokens of one split only are counted as rarest; they stand first and make no suffix. The
tokens left behind the start, the common prefix and the parities of the tokens rule out most pairs of an interval, never one with
the similarity; the rest is verified on the whole texts.

Hot intervals: an interval with more than `BLOCK` records of a split is laid out as a grid of cells, each a block of training
records against a block of evaluation records, so one task never holds more than two blocks. Equal token sets of a split
are one class, compared once and spread over their records at the end.

Defined cases: records are one per id, the latest by time (ties: the greatest text); null ids, splits and texts are left out;
texts without tokens have no partner; repeated rows are one record; extra columns play no part; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written
from .tokens import token_set

# Tokens of a suffix carried for the sort; records of a split in a cell; pairs looked at in one step.
DEPTH, BLOCK, STEP = 4, 8192, 1 << 18
_SUFFIX = ", ".join(f"t{k} bigint" for k in range(DEPTH)) + ", rec bigint, side int, n int, at int, prev bigint, s1 bigint, s2 bigint"


def _token_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, side, h1, h2, tokens): the distinct tokens as 64-bit digests in ascending order, and a 128-bit digest of the set."""
    for batch in batches:
        sets = [np.array(sorted(xxhash.xxh3_64_intdigest(t) for t in token_set(text)), np.uint64) for text in batch.column(2).to_pylist()]
        there = np.flatnonzero([len(x) > 0 for x in sets])
        own = [sets[i] for i in there.tolist()]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in own), np.int64).reshape(-1, 2)
        at = pa.array(there)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))],
            names=["id", "side", "h1", "h2", "tokens"],
        )


def first_places(n: int, threshold: float) -> int:
    """In how many first places of n tokens the first shared span of a pair with the similarity can start."""
    return n - int(np.ceil(threshold * n - 1e-9)) + 1


def _suffix_pass(threshold: float):
    """The suffixes of the ordered texts (rec, side, tokens, shared) that a first span can start at; `shared` tells which tokens both splits have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for rec, side, text, shared in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, n = np.array(text, np.int64), len(text)
                at = np.flatnonzero(np.array(shared, bool)[: first_places(n, threshold)])
                if not len(at):
                    continue
                padded = np.concatenate([x, np.zeros(DEPTH, np.int64)])
                bits = np.left_shift(np.int64(1), x & 63)
                half = (x >> 6 & 1).astype(bool)
                marks = [np.bitwise_xor.reduce(bits[half == k]) if (half == k).any() else np.int64(0) for k in (False, True)]
                same = np.ones(len(at), np.int64)
                parts.append([*(padded[at + k] for k in range(DEPTH)), same * rec, same * side, same * n, at, np.where(at > 0, x[at - 1], 0), same * marks[0], same * marks[1]])
            cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.array([], np.int64)] * (DEPTH + 7)
            kinds = [pa.int64()] * (DEPTH + 1) + [pa.int32()] * 3 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[*(f"t{k}" for k in range(DEPTH)), "rec", "side", "n", "at", "prev", "s1", "s2"])

    return run


class Intervals:
    """Pairs (a, b) of the two sides of sorted suffixes that may have the similarity, at the start of their first shared span."""

    def __init__(self, threshold: float):
        self.t = threshold

    def meet(self, a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All of one interval: a and b hold its columns, DEPTH - 1 next tokens first, of the training and the evaluation side."""
        next_b, (rec_b, n_b, at_b, prev_b, x_b, y_b) = b[: DEPTH - 1], b[DEPTH - 1 :]
        step = max(1, STEP // len(rec_b))
        for i in range(0, len(a[0]), step):
            part = [c[i : i + step] for c in a]
            next_a, (rec_a, n_a, at_a, prev_a, x_a, y_a) = part[: DEPTH - 1], part[DEPTH - 1 :]
            both = n_a[:, None] + n_b
            least = self.t * both / (1 + self.t) - 1e-6
            rest_a, rest_b = (n_a - at_a)[:, None], n_b - at_b
            most = np.minimum(rest_a, rest_b)
            i_a, i_b = np.nonzero(most >= least)
            if not len(i_a):
                continue
            # Only for the pairs left: the span starts here; with as many tokens left on both sides, texts that part cost one; parities differ
            # in at most as many bits as tokens are in one set only.
            keep = (prev_a[i_a] != prev_b[i_b]) | (at_a[i_a] == 0) | (at_b[i_b] == 0)
            i_a, i_b = i_a[keep], i_b[keep]
            parts = np.zeros(len(i_a), bool)
            for x, y in zip(next_a, next_b):
                parts |= x[i_a] != y[i_b]
            need, own, other = least[i_a, i_b], rest_a[i_a, 0], rest_b[i_b]
            keep = np.minimum(own, other) - (parts & (own == other)) >= need
            differ = np.bitwise_count((x_a[i_a] ^ x_b[i_b]).view(np.uint64)).astype(np.int64) + np.bitwise_count((y_a[i_a] ^ y_b[i_b]).view(np.uint64))
            keep &= differ <= both[i_a, i_b] - 2 * need
            yield rec_a[i_a[keep]], rec_b[i_b[keep]]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come as (t0, row, col, side, t1.., rec, n, at, prev, s1, s2), sorted by the first four; an open interval is kept from batch to batch."""
        kept: list[np.ndarray] | None = None
        for batch in _with_end(batches):
            rows = [kept] if kept is not None else []
            if batch is not None and batch.num_rows:
                rows.append([np.asarray(c) for c in batch.columns])
            if not rows:
                continue
            cols = [np.concatenate(x) for x in zip(*rows)]
            new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])])
            begins = np.flatnonzero(new)
            kept = [c[begins[-1] :] for c in cols] if batch is not None else None
            found = []
            for f, e in zip(begins.tolist(), [*begins[1:].tolist(), *([len(new)] if batch is None else [])]):
                middle = f + int(np.searchsorted(cols[3][f:e], 1))
                if f < middle < e:
                    found += self.meet([c[f:middle] for c in cols[4:]], [c[middle:e] for c in cols[4:]])
            a = np.concatenate([x for x, _ in found]) if found else np.array([], np.int64)
            b = np.concatenate([x for _, x in found]) if found else np.array([], np.int64)
            pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _with_end(batches):
    yield from batches
    yield None


def shared_spans(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the maximal spans two texts of distinct tokens share."""
    place = {t: j for j, t in enumerate(b)}
    spans: list[tuple[int, int, int]] = []
    for i, t in enumerate(a):
        j = place.get(t)
        if j is None:
            continue
        if spans and spans[-1][0] + spans[-1][2] == i and spans[-1][1] + spans[-1][2] == j:
            spans[-1] = (*spans[-1][:2], spans[-1][2] + 1)
        else:
            spans.append((i, j, 1))
    return spans


def _cover_pass(threshold: float):
    """Pairs (a, b) with their packed texts: the shares of both that shared spans cover, the similarity, and the longest span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                u, v = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                every = np.concatenate([u, v])
                every.sort()
                both = int((every[1:] == every[:-1]).sum())
                if both >= threshold * (len(every) - both) - 1e-9:
                    spans = shared_spans(u.tolist(), v.tolist())
                    covered = sum(s[2] for s in spans)
                    rows.append((k, covered / (len(u) + len(v) - covered), covered / len(u), covered / len(v), max(s[2] for s in spans)))
            cols = list(zip(*rows)) or [[]] * 5
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, pa.float64()) for c in cols[1:4]), pa.array(cols[4], pa.int32())], names=["a", "b", "similarity", "cover_a", "cover_b", "longest"]
            )

    return run


def _ordered_texts(classes: DataFrame) -> DataFrame:
    """(rec, side, tokens, shared): the texts in the common order, by the product of a token's counts in the two splits, then by its digest."""
    tokens = classes.select("rec", "side", F.explode("tokens").alias("token"))
    count = [F.count_if(F.col("side") == k).cast("double") for k in (0, 1)]
    cost = tokens.groupBy("token").agg((count[0] * count[1]).alias("cost"))
    lined = tokens.join(cost, "token").groupBy("rec", "side").agg(F.array_sort(F.collect_list(F.struct("cost", "token"))).alias("x"))
    return lined.select("rec", "side", F.col("x.token").alias("tokens"), F.transform("x", lambda e: e["cost"] > 0).alias("shared"))


def _cells(suffixes: DataFrame) -> DataFrame:
    """The suffixes of intervals of both splits, in each cell (row, col) of their interval's grid where they are compared."""
    heads = suffixes.groupBy("t0").agg(*(F.ceil(F.count_if(F.col("side") == k) / F.lit(BLOCK)).cast("int").alias(c) for k, c in ((0, "_a"), (1, "_b")))).where("_a > 0 and _b > 0")
    own = suffixes.join(heads, "t0").withColumn("_own", F.when(F.col("side") == 0, F.col("_a")).otherwise(F.col("_b"))).withColumn("_own", F.pmod(F.xxhash64("rec"), "_own").cast("int"))
    across = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("_b")).otherwise(F.col("_a")) - 1)
    spread = own.withColumn("_other", F.explode(across))
    row, col = F.when(F.col("side") == 0, F.col("_own")).otherwise(F.col("_other")), F.when(F.col("side") == 0, F.col("_other")).otherwise(F.col("_own"))
    return spread.select("t0", row.alias("row"), col.alias("col"), "side", *(f"t{k}" for k in range(1, DEPTH)), "rec", F.col("n").cast("bigint"), F.col("at").cast("bigint"), "prev", "s1", "s2")


def cross_split_overlaps(df: DataFrame, row_id: str, text: str, split: str, time: str, train: str = "train", against: tuple[str, ...] = ("dev", "holdout"), threshold: float = 0.7) -> DataFrame:
    """(id_a, id_b, similarity, cover_a, cover_b, longest): id_a of the training split, id_b of an evaluation split; `longest` shared span in tokens of the common order."""
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.lower(F.trim(F.regexp_replace(F.col(split), "\\s+", " "))).alias("split"), F.col(time).alias("time"))
    rows = rows.where("id is not null").groupBy("id").agg(F.max(F.struct("time", "text", "split")).alias("r")).select("id", "r.text", "r.split")
    rows = rows.where(F.col("text").isNotNull() & F.col("split").isin(train, *against)).withColumn("side", F.when(F.col("split") == train, 0).otherwise(1))
    kind = rows.schema["id"].dataType.simpleString()
    known = written(rows.select("id", "side", "text").mapInArrow(_token_pass, f"id {kind}, side int, h1 bigint, h2 bigint, tokens array<bigint>"))
    classes = written(known.dropDuplicates(["side", "h1", "h2"]).drop("id").withColumn("rec", F.monotonically_increasing_id()))
    texts = written(_ordered_texts(classes))
    suffixes = written(texts.mapInArrow(_suffix_pass(threshold), _SUFFIX))
    order = ["t0", "row", "col", "side", *(f"t{k}" for k in range(1, DEPTH))]
    pairs = _cells(suffixes).repartition("t0", "row", "col").sortWithinPartitions(*order).mapInArrow(Intervals(threshold), "a bigint, b bigint").distinct()
    packed = texts.mapInArrow(_pack_pass, "rec bigint, packed binary")
    a, b = packed.select(F.col("rec").alias("a"), F.col("packed").alias("x")), packed.select(F.col("rec").alias("b"), F.col("packed").alias("y"))
    near = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_cover_pass(threshold), "a bigint, b bigint, similarity double, cover_a double, cover_b double, longest int")
    members = known.drop("tokens").join(classes.drop("tokens"), ["side", "h1", "h2"])
    ids_a, ids_b = members.select(F.col("rec").alias("a"), F.col("id").alias("id_a")), members.select(F.col("rec").alias("b"), F.col("id").alias("id_b"))
    return written(near).join(ids_a, "a").join(ids_b, "b").select("id_a", "id_b", "similarity", "cover_a", "cover_b", "longest")


def _pack_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(2)
        flat, ends = np.asarray(column.flatten()), np.cumsum(np.asarray(column.value_lengths()))[:-1]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.split(flat, ends)] if batch.num_rows else [], pa.binary())], names=["rec", "packed"])
