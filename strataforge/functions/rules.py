"""Scalar text functions: titles, clauses, keyword classes, URLs, redaction, summaries, hashed vectors."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

# What is redacted.
SECRET_ASSIGNMENT = r"(?i)(\b(?:api[_\s-]?key|access[_\s-]?token|authorization|cookie|password|secret|token)\b\s*[:=]\s*)(?:bearer\s+)?([^\s,;]+)"
BEARER = r"(?i)\bbearer\s+[A-Za-z0-9._~+\-/]+=*"
KEY = r"\bsk-[A-Za-z0-9_-]{8,}\b"


CLASS_CLAUSE = "[;；。\\n]+"


def url_identity(url: Column) -> Column:
    """An HTTP address as the identity of a source; null if it is none."""
    return F.when(url.rlike("^(?i)https?://[^/?#]+"), url)


def document_title(text: Column, fallback: Column) -> Column:
    """The first top-level heading, else the fallback."""
    found = F.regexp_extract(text, "(?m)^#\\s+(.+?)\\s*$", 1)
    return F.when(found != "", found).otherwise(fallback)


def clauses(text: Column) -> Column:
    """Clauses at semicolons, line breaks and sentence ends; those beyond the third are joined to it."""
    parts = F.filter(F.transform(F.split(text, "[;；\\n。]+|(?<=[a-z])\\.\\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 3, F.concat(F.slice(parts, 1, 2), F.array(F.array_join(F.slice(parts, 3, 1 << 20), " ")))).otherwise(parts)


def contains_term(text: Column, term: str) -> Column:
    """Latin terms as whole words, others as substrings, of lower-case text."""
    if all(c.isascii() for c in term):
        return text.rlike(f"(?<![a-z0-9_]){term.lower()}(?![a-z0-9_])")
    return text.contains(term.lower())


def keyword_class(text: Column, classes: dict[str, list[str]], default: str = "general") -> Column:
    """The class with most keywords found; ties go to the earlier class; none found gives the default."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scored = [F.struct(sum((contains_term(low, t).cast("int") for t in terms), F.lit(0)).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, terms) in enumerate(classes.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, best["name"]).otherwise(default)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default port and fragment dropped, query sorted, no slash at the end of a path; null if not HTTP."""
    scheme, host = F.lower(F.parse_url(url, F.lit("PROTOCOL"))), F.lower(F.parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(F.parse_url(url, F.lit("AUTHORITY")), ":(\\d+)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    query = F.array_join(F.array_sort(F.split(F.parse_url(url, F.lit("QUERY")), "&")), "&")
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query.isNotNull() & (query != ""), F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & host.isNotNull(), out)


def redacted(text: Column) -> Column:
    """Secrets replaced: assignments keep their name, bearer values and keys go."""
    out = F.regexp_replace(text, F.lit(SECRET_ASSIGNMENT), F.lit("$1[REDACTED]"))
    return F.regexp_replace(F.regexp_replace(out, F.lit(BEARER), F.lit("Bearer [REDACTED]")), F.lit(KEY), F.lit("[REDACTED]"))


def value_summary(text: Column) -> Column:
    """Length and hash in the place of a text."""
    return F.struct(F.lit("text").alias("type"), F.char_length(text).alias("length"), F.sha2(text, 256).alias("sha256"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """A prefix and the first twenty hex digits of the parts' hash; stable within this engine."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 20))


def token_cost(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 3))


def hashed_vector_of(text: str, dimension: int = 512) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the folded text without blanks, unit length; the empty text gives zeros."""
    folded = "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if not c.isspace())
    grams = [folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1)]
    distinct, counts = np.unique(np.array(grams, object), return_counts=True) if grams else ([], [])
    out = np.zeros(dimension, np.float64)
    for gram, k in zip(distinct, counts):
        out[int.from_bytes(hashlib.sha256(gram.encode()).digest()[:4], "big") % dimension] += k
    norm = np.sqrt((out * out).sum())
    return (out / norm if norm else out).astype(np.float32)


def hashed_matrix(texts: list[str], known: dict[int, int], dimension: int = 512) -> np.ndarray:
    """hashed_vector_of of every text, one row each; `known` keeps the places of grams seen before."""
    folded = ["".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in texts]
    points = np.array([ord(c) for t in folded for c in t], np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in folded])
    out = np.zeros(len(texts) * dimension)
    code = points + 1
    for n in (1, 2, 3):
        if n > 1:
            code = (code[:-1] << 21) | (points[n - 1 :] + 1)
        within = row[: len(code)] == row[n - 1 :]
        which, distinct = pd.factorize(code[within])
        places = np.empty(len(distinct), np.int64)
        if len(known) > 2_000_000:
            known.clear()
        for i, c in enumerate(distinct.tolist()):
            if c not in known:
                gram = "".join(chr(((c >> (21 * k)) & 0x1FFFFF) - 1) for k in range(n - 1, -1, -1))
                known[c] = int.from_bytes(hashlib.sha256(gram.encode()).digest()[:4], "big") % dimension
            places[i] = known[c]
        out += np.bincount(row[: len(code)][within] * dimension + places[which], minlength=len(out))
    out = out.reshape(len(texts), dimension)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def hashed_vector(x: pd.Series) -> pd.Series:
    return x.map(hashed_vector_of, na_action="ignore")


@F.pandas_udf(ArrayType(FloatType()))
def hashed_vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As hashed_vector, for columns of many texts: whole batches at once, grams seen before are not hashed again."""
    known: dict[int, int] = {}
    for x in batches:
        parts = [hashed_matrix([t or "" for t in x.iloc[i : i + 500]], known) for i in range(0, len(x), 500)]
        yield pd.Series([v if t is not None else None for t, v in zip(x, (row for part in parts for row in part))], index=x.index, dtype=object)


def extractive_draft(df: DataFrame, group: str, order: str, text: Column, most: int = 3) -> DataFrame:
    """(group, draft): the first distinct texts of each group in order, joined; at most `most` are ever held for a group."""
    from .text import squeeze
    from pyspark.sql import Window

    rows = df.select(group, F.col(order).alias("_at"), squeeze(text).alias("_text")).where("_text <> ''")
    first = rows.groupBy(group, "_text").agg(F.min("_at").alias("_at"))
    top = first.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_at"))).where(F.col("_n") <= most)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_text"))), lambda s: s["_text"]), "；").alias("draft"))
