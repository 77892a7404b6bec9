"""Choosing evidence: membership, bounded greedy selection, context around hits, and extension slots.

The greedy choices are sequential by nature. Each is a pure function over the few rows of one request, run over a table whose
requests are sorted and streamed, so a request's rows are bounded by its rankings' depth and nothing else is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType


def facet_matches(facet: Column, wanted: str) -> Column:
    """The list holds the value or the wildcard; a null list matches nothing."""
    return F.coalesce(F.array_contains(facet, "*") | F.array_contains(facet, wanted), F.lit(False))


def path_allowed(path: Column, prefixes: list[str]) -> Column:
    """The path is one of the prefixes or lies below one."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p.rstrip("/") + "/")
    return F.coalesce(out, F.lit(False))


def cited_membership(claims: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, cited, valid, all_valid): claims are valid where the hits of the same query hold them; one invalid claim fails the answer."""
    there = hits.select(*keys).distinct().withColumn("_there", F.lit(1))
    own = claims.distinct().join(there, keys, "left").groupBy(keys[0]).agg(F.count("*").alias("cited"), F.count("_there").alias("valid"))
    return own.withColumn("all_valid", F.col("cited") == F.col("valid"))


def select_evidence(rows: list[dict], most: int) -> list[dict]:
    """Three passes over hits (facet, rank, document, overlap): each facet's best by overlap in an unseen document, unseen documents with overlap, then the rest."""
    chosen: list[dict] = []
    seen: set = set()

    def take(row: dict) -> None:
        chosen.append(row)
        seen.add(row["document"])

    for _, group in groupby(rows, key=lambda r: r["facet"]):
        fresh = [r for r in group if r["document"] not in seen]
        if fresh and len(chosen) < most:
            take(max(fresh, key=lambda r: r["overlap"]))
    for wanted in (lambda r: r["document"] not in seen and r["overlap"] > 0, lambda r: True):
        for row in rows:
            if len(chosen) < most and wanted(row) and not any(row is c for c in chosen) and row["pos"] not in {c["pos"] for c in chosen}:
                take(row)
    return chosen


def merge_images(hits: list[dict], images: list[dict], most: int) -> list[dict]:
    """Each image not there yet takes the place of the last row of its document, else of the last row of a document with several, else a free place; a document is never lost for an image."""
    out = list(hits[:most])
    for image in images:
        if any(row["pos"] == image["pos"] for row in out):
            continue
        documents = [row["document"] for row in out]
        places = [i for i, name in enumerate(documents) if name == image["document"]] or [i for i, name in enumerate(documents) if documents.count(name) > 1]
        if places:
            out[places[-1]] = image
        elif len(out) < most:
            out.append(image)
    return out


def expand_context(hits: list[dict], around: dict, budget: int) -> list[dict]:
    """Hits, each with its section's anchor and neighbours outwards, while the token budget lasts: the first hit always, a later hit over it ends all, other rows over it are skipped."""
    out: list[dict] = []
    seen: set = set()
    spent = 0
    for hit in hits:
        if hit["pos"] not in seen:
            if out and spent + hit["cost"] > budget:
                break
            out.append(hit)
            seen.add(hit["pos"])
            spent += hit["cost"]
        for row in around.get(hit["pos"], []):
            if row["pos"] not in seen and spent + row["cost"] <= budget:
                out.append(row)
                seen.add(row["pos"])
                spent += row["cost"]
    return out


def by_request(df: DataFrame, request: str, order: list[str], choose: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Apply a choice to the sorted rows of each request; only one request's rows are held."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for frame in frames:
                yield from frame.to_dict("records")

        held = []
        for _, group in groupby(rows(), key=lambda r: r[request]):
            held += [{n: r.get(n) for n in names[:-1]} | {names[-1]: k} for k, r in enumerate(choose(list(group)), 1)]
            if len(held) > 2000:
                yield pd.DataFrame(held, columns=names)
                held = []
        yield pd.DataFrame(held, columns=names)

    return df.repartition(request).sortWithinPartitions(request, *order).mapInPandas(run, schema)


def profile_matches(df: DataFrame, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """`df` with a row for each named pattern (Java regular expressions of a user's profile, checked here) that its text holds, in column `pattern`."""
    import re

    if len({name for name, _ in patterns}) < len(patterns) or any(not name.strip() for name, _ in patterns):
        raise ValueError("patterns need different names")
    for _, pattern in patterns:
        re.compile(pattern)
    found = F.array(*(F.when(F.col(text).rlike(pattern), F.lit(name)) for name, pattern in patterns))
    return df.withColumn("pattern", F.explode(F.array_compact(found)))


def embedder(encode: Callable[[list[str]], list], dimension: int):
    """A column function from a Python callable on lists of texts; a null text gives null, a wrong dimension fails."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(x: pd.Series) -> pd.Series:
        known = x.dropna()
        vectors = encode(known.tolist()) if len(known) else []
        if any(len(v) != dimension for v in vectors):
            raise ValueError(f"vectors of {dimension} numbers are needed")
        return pd.Series([list(map(float, v)) for v in vectors], index=known.index, dtype=object).reindex(x.index)

    return embed


def generator(generate: Callable[[str], str] | None):
    """A column function from a Python callable on a text; without one every answer is GENERATION_NOT_CONFIGURED."""

    @F.pandas_udf(StringType())
    def answer(x: pd.Series) -> pd.Series:
        return x.map(generate, na_action="ignore") if generate else pd.Series(["GENERATION_NOT_CONFIGURED"] * len(x), index=x.index)

    return answer


def identifier_spans(df: DataFrame, row_id: str, text: str, pattern: str) -> DataFrame:
    """(id, start, end, identifier) of all matches in order; positions in code points."""
    import re

    found = re.compile(pattern)
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    kind = rows.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(i, m.start(), m.end(), m[0]) for i, t in zip(frame["id"], frame["text"]) for m in found.finditer(t)]
            yield pd.DataFrame(out, columns=["id", "start", "end", "identifier"])

    return rows.mapInPandas(run, f"id {kind}, start int, end int, identifier string")
