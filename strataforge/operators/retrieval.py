"""Ranking: lexical, fielded, dense, fused and re-ordered, all in one plan for any number of queries.

Statistics come from the whole corpus and scopes are applied to scored rows only, except where said. Scores are rounded to six
digits, and ties go by the row's position, so a ranking doesn't depend on how the data is partitioned.
Queries and chunks meet on terms; the query side is broadcast only where the engine measures it to be small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import tokens
from ..plans.tables import written
from . import best, index

K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 3.0, "heading_path": 4.0, "body": 1.0}


def corpus_index(chunks: DataFrame) -> DataFrame:
    """The index of title, heading path and body, or of the body alone where the corpus has no more; the same one for all rankers."""
    fields = {"body": F.col("content")}
    if {"document_title", "heading_path"} <= set(chunks.columns):
        fields = {"title": F.col("document_title"), "heading_path": F.array_join("heading_path", " "), **fields}
    return index.built(chunks, fields)


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, term, qtf): the distinct terms of each query, written, so that the engine knows the size of this side and carries it to the postings if it is small."""
    rows = queries.select(F.col(query_id).alias("query_id"), F.explode_outer(tokens(F.col(text))).alias("term"))
    return written(rows.where("term is not null").groupBy("query_id", "term").agg(F.count("*").alias("qtf")))


def weighted(terms: DataFrame, found: DataFrame, stats: DataFrame) -> DataFrame:
    """The terms with their idf and the one row of statistics, written for the same reason; `df` counts each corpus row once."""
    df = found.groupBy("term").agg(F.countDistinct("pos").alias("df")) if "field" in found.columns else found.groupBy("term").agg(F.count("*").alias("df"))
    rows = terms.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    return written(rows.withColumn("idf", idf(F.col("n"), F.col("df"))).drop("df", "n"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25(chunks: DataFrame, queries: DataFrame, query_id: str = "query_id", text: str = "query", weighted_terms: bool = False, least_terms: int = 1) -> DataFrame:
    """(query_id, pos, score) of all chunks (pos, content) with a term of the query."""
    terms, own = query_terms(queries, query_id, text), corpus_index(chunks)
    weights = weighted(terms, index.postings(own, "body", terms).drop("field"), index.averages(own, ["body"]))
    scored = index.postings(own, "body").join(weights, "term")
    weight = F.col("qtf") if weighted_terms else F.lit(1)
    part = weight * F.col("idf") * saturation(F.col("tf"), F.col("length"), F.col("avg_body"))
    out = scored.groupBy("query_id", "pos").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))
    return out.where(F.col("matched") >= least_terms).select("query_id", "pos", "score")


def bm25_fields(chunks: DataFrame, queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, pos, score) over title, heading path and body with shared document frequencies."""
    terms, own = query_terms(queries, query_id, text), corpus_index(chunks)
    weights = weighted(terms, index.postings(own, None, terms), index.averages(own, list(FIELD_WEIGHTS)))
    scored = index.postings(own).join(weights, "term")
    weight, average = F.lit(None), F.lit(None)
    for name, w in FIELD_WEIGHTS.items():
        weight = F.when(F.col("field") == name, F.lit(w)).otherwise(weight)
        average = F.when(F.col("field") == name, F.col(f"avg_{name}")).otherwise(average)
    part = weight * F.col("idf") * saturation(F.col("tf"), F.col("length"), average)
    return scored.groupBy("query_id", "pos").agg(F.round(F.sum(part), 6).alias("score"))


def token_overlap(chunks: DataFrame, queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, pos, score): how many distinct query terms a chunk has."""
    terms = query_terms(queries, query_id, text)
    return index.postings(corpus_index(chunks), "body").join(terms, "term").groupBy("query_id", "pos").agg(F.count("*").cast("double").alias("score"))


def lexical(chunks: DataFrame, queries: DataFrame, prefer: Column | None = None, scope: Column | None = None, query_id: str = "query_id", text: str = "query") -> best.Corpus:
    """The chunks as blocks for the queries, with title and heading path where the corpus has them; the same ones for all rankers."""
    fields = {"body": F.col("content")}
    if {"document_title", "heading_path"} <= set(chunks.columns):
        fields = {"title": F.col("document_title"), "heading_path": F.array_join("heading_path", " "), **fields}
    label = F.col("document_id") if "document_id" in chunks.columns else None
    return best.corpus(chunks, fields, queries, query_id, text, label, prefer, scope)


def best_hits(chunks: DataFrame, queries: DataFrame, k: int, fields: bool = False, prefer_language: str | None = None, scope: Column | None = None, **more) -> DataFrame:
    """As top_hits of bm25, bm25_fields (`fields`) or token_overlap (`plain`) scores, which are never written for all pairs of query and chunk."""
    prefer = F.col("language") == prefer_language if prefer_language else None
    found = best.best(lexical(chunks, queries, prefer, scope), FIELD_WEIGHTS if fields else {"body": 1.0}, k, **more)
    found = found if prefer_language else ranked(found, [F.desc("score"), F.asc("pos")], k).drop("rank")
    return top_hits(written(found), chunks, k, prefer_language)


def best_ranked(chunks: DataFrame, queries: DataFrame, k: int, fields: bool = False) -> DataFrame:
    """(query_id, pos, score, rank): the first k by score and position."""
    return written(ranked(best.best(lexical(chunks, queries), FIELD_WEIGHTS if fields else {"body": 1.0}, k), [F.desc("score"), F.asc("pos")], k))


def best_by_document(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As scored_in of bm25, only those chunks that can be among a query's best k or the best of its k best documents."""
    return scored_in(written(best.best(lexical(chunks, queries), {"body": 1.0}, k, labels=True)), chunks)


def figure_hits(rows: DataFrame, queries: DataFrame, k: int, most: int, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, rank, pos, score): the best min(k, most) figure rows (pos, chunk_id, document_key, heading, content).

    Statistics are those of the given rows, repeated query terms count as often, at least two different ones must stand in the content itself; ties go by chunk_id.
    """
    whole = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("heading", "document_key", "content")))
    own = best.corpus(rows, {"whole": whole, "content": F.col("content")}, queries, query_id, text, F.col("chunk_id"))
    scores = best.best(own, {"whole": 1.0}, min(k, most), repeated=True, least_average=1.0, tie=True, two=("content", 2))
    hits = written(scores.where("score > 0")).join(rows.select("pos", "chunk_id"), "pos")
    return ranked(hits, [F.desc("score"), F.asc("chunk_id"), F.asc("pos")], min(k, most)).select("query_id", "rank", "pos", "score")


def ranked(scores: DataFrame, order: list[Column], limit: int | None = None, by: str = "query_id") -> DataFrame:
    """Adds `rank` from 1 within each query; with a limit, ranks beyond it are cut in every partition before the shuffle."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out.where(F.col("rank") <= limit) if limit else out


def top_hits(scores: DataFrame, chunks: DataFrame, k: int, prefer_language: str | None = None, scope: Column | None = None) -> DataFrame:
    """Top k within the scope: score, then the preferred language, then position. Contents are not carried through the ranking."""
    rows = scores.join(chunks.select("pos", "language", "version", "document_id").where(scope if scope is not None else F.lit(True)), "pos")
    order = [F.desc("score"), *([F.desc(F.coalesce(F.col("language") == prefer_language, F.lit(False)))] if prefer_language else []), F.asc("pos")]
    return ranked(rows.where("score > 0"), order, k)


def best_of_documents(hits: DataFrame, prefix: int, k: int) -> DataFrame:
    """Of scored hits (query_id, document_id, pos, score) the rows a re-ordering to k rows can need: the best prefix + k, and the best k of the documents' best.

    Both are cut in every partition before a shuffle, so no task sees all hits of a query.
    """
    order = [F.desc("score"), F.asc("pos")]
    top = ranked(hits, order, prefix + k).drop("rank")
    first = hits.groupBy("query_id", "document_id").agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("pos"), F.max("score").alias("score"))
    first = ranked(first, order, prefix + k).drop("rank")
    return top.unionByName(first.select(*top.columns)).distinct()


def source_diverse(hits: DataFrame, prefix: int, k: int) -> DataFrame:
    """Hits re-ordered: the first `prefix`, then the best positive one of each document not seen yet, then the rest; the first k."""
    order = [F.desc("score"), F.asc("pos")]
    rows = ranked(best_of_documents(hits.select("query_id", "document_id", "pos", "score"), prefix, k), order)
    w = Window.partitionBy("query_id", "document_id").orderBy("rank")
    flagged = rows.withColumn("in_prefix", F.col("rank") <= prefix).withColumn("nth", F.row_number().over(w))
    seen = F.max("in_prefix").over(Window.partitionBy("query_id", "document_id"))
    group = F.when(F.col("in_prefix"), 0).when(~seen & (F.col("nth") == 1) & (F.col("score") > 0), 1).otherwise(2)
    return ranked(flagged.withColumn("grp", group).drop("rank"), [F.asc("grp"), *order], k).drop("grp", "in_prefix", "nth")


def capped_per_document(hits: DataFrame, cap: int, k: int) -> DataFrame:
    """At most `cap` chunks of a document, the first k; the cap is taken in every partition before the shuffle."""
    w = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), F.asc("pos"))
    kept = hits.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap)
    return ranked(kept.drop("nth"), [F.desc("score"), F.asc("pos")], k)


def scored_in(scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """Positive scores with the document of each chunk."""
    return scores.where("score > 0").join(chunks.select("pos", "document_id"), "pos")


def fused(rankings: DataFrame, k: int, rrf_k: int = 60, weight: Column | None = None) -> DataFrame:
    """(query_id, pos, rrf, lists, rank) from (query_id, list_id, pos, rank): the sum of weight / (rrf_k + rank), ties by position."""
    part = (weight if weight is not None else F.lit(1.0)) / (rrf_k + F.col("rank"))
    scores = rankings.groupBy("query_id", "pos").agg(F.round(F.sum(part), 9).alias("rrf"), F.array_join(F.array_sort(F.collect_set(F.col("list_id").cast("string"))), ",").alias("lists"))
    return ranked(scores, [F.desc("rrf"), F.asc("pos")], k)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_hits(vectors: DataFrame, queries: DataFrame, k: int, same_scope: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): exact top k by dot product; vectors (vec_id, embedding, label), queries (query_id, query_vec, scope).

    The queries are a stated set against all rows; with `same_scope` they meet on the label, so the scope comes before scoring.
    """
    pairs = vectors.join(queries, vectors["label"] == queries["scope"]) if same_scope else vectors.crossJoin(queries)
    scored = pairs.select("query_id", "vec_id", F.round(dot("embedding", "query_vec"), 6).alias("score"))
    return ranked(scored, [F.desc("score"), F.asc("vec_id")], k)


def hashed_hits(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, pos, score, rank): exact top k of all chunks (pos, content) by the dot product of hashed vectors, scored block by block.

    The queries (query_id, query) are a stated set against all rows; every chunk with a content has a vector, whether or not it shares a token.
    """
    return ranked(best.dense_best(chunks, queries, k), [F.desc("score"), F.asc("pos")], k)


def facets(query: Column, most: int = 4) -> Column:
    """Explicit clauses at `;`, `；` and line breaks, list marks stripped; one clause gives the query as it is, those beyond `most` are joined."""
    parts = F.filter(F.transform(F.split(query, "[;；\\n]+"), lambda p: F.trim(F.regexp_replace(p, "^\\s*(?:[-*•]|\\d+[.)、])\\s*", ""))), lambda p: p != "")
    joined = F.concat(F.slice(parts, 1, most - 1), F.array(F.array_join(F.slice(parts, most, 1 << 20), "；")))
    return F.when(F.size(parts) <= 1, F.array(query)).when(F.size(parts) > most, joined).otherwise(parts)


# Fixed value: words that make no compound with their neighbour.
LOOSE = frozenset(
    "what is the a an of for to does do how which in on from and or can could would with 如何 怎么 什么 哪些 是否 可以 通过 并通 过命 令行 行参 数启 用或 或禁 用模 请问 请 吗 的 与 和 从 到 中 里 了 吗？ 呢".split()
)


def aliased(terms: list[str], known: set[str]) -> list[str]:
    """Terms as the corpus writes them: an unknown hyphenated one as its parts if all of them are known, then neighbours as the compound that is known."""
    apart: list[str] = []
    for term in terms:
        parts = [p for p in term.split("-") if p]
        apart += parts if term not in known and len(parts) > 1 and known.issuperset(parts) else [term]
    out: list[str] = []
    joined = False
    for left, right in zip(apart, [*apart[1:], None]):
        if joined:
            joined = False
            continue
        joined = right is not None and not LOOSE & {left, right} and f"{left}-{right}" in known
        out.append(f"{left}-{right}" if joined else left)
    return out


def _possible(terms: list[str]) -> set[str]:
    """All that terms could turn into: themselves, their parts, and compounds of neighbours, either one whole or its nearest part."""
    parts = [[p for p in t.split("-") if p] or [t] for t in terms]
    found = {*terms, *(p for own in parts for p in own), *(f"{x}-{y}" for own in parts for x, y in zip(own, own[1:]))}
    for (a, b), (own, other) in zip(zip(terms, terms[1:]), zip(parts, parts[1:])):
        found |= {f"{x}-{y}" for x in (a, own[-1]) for y in (b, other[0])}
    return found


def compound_aliases(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, aliased): the terms of each query (query_id, query) with compounds as in the corpus.

    Only terms a query could turn into are looked up in the postings, by one join; what comes back for a query is bounded by its own length.
    """
    rows = queries.select("query_id", tokens(F.col("query")).alias("terms"))

    @F.pandas_udf(ArrayType(StringType()))
    def possible(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: sorted(_possible(list(t))))

    asked = rows.select("query_id", F.explode(possible("terms")).alias("term"))
    known = asked.join(postings.select("term").distinct(), "term", "left_semi").groupBy("query_id").agg(F.collect_set("term").alias("known"))

    @F.pandas_udf(StringType())
    def join(terms: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([" ".join(aliased(list(t), set(k) if k is not None else set())) for t, k in zip(terms, known)])

    return rows.join(known, "query_id", "left").select("query_id", join("terms", "known").alias("aliased"))
