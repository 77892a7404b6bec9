"""JSON that is decoded under a contract, canonical JSON, and texts made safe to show."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .rules import BEARER, KEY, SECRET_ASSIGNMENT

ANSWER = StructType().add("valid", "boolean").add("claims", "integer").add("cited", ArrayType(StringType())).add("final_answer", "string")
REVIEW = StructType().add("valid", "boolean").add("candidates", ArrayType(StringType()))
# Messages of failures that pass, and the chain of phrases a message is classified by.
PASSING = ["connection reset", "connection aborted", "connection refused", "tls eof", "ssl eof", "unexpected eof", "temporarily unavailable", "remote protocol error"]
PHRASES = [
    ("TOOL_CAPABILITY_UNAVAILABLE", False, ["no public full-document", "capability unavailable", "unknown tool"]),
    ("RATE_LIMITED", True, ["429", "rate limit", "too many requests"]),
    ("ACCESS_DENIED", False, ["403", "forbidden", "access denied"]),
    ("AUTHENTICATION_FAILED", False, ["401", "authentication failed", "unauthorized"]),
    ("OPERATION_TIMEOUT", True, ["timed out", "timeout"]),
    ("TRANSIENT_NETWORK", True, PASSING),
    ("UNSUPPORTED_CONTENT", False, ["unsupported"]),
    ("RESPONSE_PARSE_FAILED", False, ["parse", "invalid response", "schema"]),
    ("INVALID_INPUT", False, ["invalid", "must be", "validation"]),
]
# Statuses of an HTTP answer; 500 and above may be tried again.
STATUSES = {401: ("AUTHENTICATION_FAILED", False), 403: ("ACCESS_DENIED", False), 429: ("RATE_LIMITED", True), 408: ("OPERATION_TIMEOUT", True), 400: ("INVALID_INPUT", False)}
_URL = re.compile(r"https?://[^\s<>\"']+", re.IGNORECASE)


def error_class(message: Column, status: Column | None = None) -> Column:
    """(code, retryable) of a failure: by its HTTP status if there is one, else by the first phrase its message holds."""
    low = F.lower(F.coalesce(message, F.lit("")))

    def verdict(code: str, again) -> Column:
        return F.struct(F.lit(code).alias("code"), (again if isinstance(again, Column) else F.lit(again)).alias("retryable"))

    chain = None
    if status is not None:
        for number, (code, again) in STATUSES.items():
            chain = (F if chain is None else chain).when(status == number, verdict(code, again))
        chain = chain.when(status.isNotNull(), verdict("EXTERNAL_SERVICE_FAILED", status >= 500))
    for code, again, phrases in PHRASES:
        there = low.contains(phrases[0])
        for phrase in phrases[1:]:
            there = there | low.contains(phrase)
        chain = (F if chain is None else chain).when(there, verdict(code, again))
    return chain.otherwise(verdict("INTERNAL_ERROR", False))


def canonical_json(payload: str | None) -> str | None:
    """JSON with sorted keys and no blanks; null and what is no JSON give null."""
    try:
        return None if payload is None else json.dumps(json.loads(payload), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_hash(x: pd.Series) -> pd.Series:
    """SHA-256 of the canonical JSON."""
    return x.map(lambda p: hashlib.sha256(own.encode()).hexdigest() if (own := canonical_json(p)) is not None else None)


def _bounded(value: Any, most: int) -> bool:
    return isinstance(value, str) and bool(value.strip()) and len(value) <= most


def _names(values: Any, least: int, most: int) -> bool:
    return isinstance(values, list) and least <= len(values) <= most and all(_bounded(v, 250) for v in values) and len(set(values)) == len(values)


def _page(source: Any) -> bool:
    return isinstance(source, dict) and set(source) == {"document_id", "page_number"} and isinstance(source["document_id"], str) and type(source["page_number"]) is int and source["page_number"] > 0


def answer_of(payload: str | None) -> dict:
    """Whether an answer keeps its contract: at most five claims with different texts, one to five different names each, and sources with pages."""
    bad = {"valid": False, "claims": None, "cited": None, "final_answer": None}
    try:
        value = json.loads((payload or "").strip())
    except ValueError:
        return bad
    if not isinstance(value, dict) or set(value) != {"claims", "relevant_sources"} or not isinstance(value["claims"], list) or not isinstance(value["relevant_sources"], list):
        return bad
    claims = value["claims"]
    whole = len(claims) <= 5 and all(isinstance(c, dict) and set(c) == {"text", "evidence_ids"} and _bounded(c["text"], 1000) and _names(c["evidence_ids"], 1, 5) for c in claims)
    if not whole or not all(map(_page, value["relevant_sources"])):
        return bad
    texts = [c["text"].strip() for c in claims]
    if len(set(texts)) < len(texts):
        return bad
    return {"valid": True, "claims": len(texts), "cited": [e for c in claims for e in c["evidence_ids"]], "final_answer": "\n".join(texts) or "N/A"}


def review_of(payload: str | None) -> dict:
    """Whether a review keeps its contract: a bounded reading, at most five candidates with different names, three lists of at most eight texts, and a status left to people."""
    bad = {"valid": False, "candidates": None}
    try:
        value = json.loads((payload or "").strip())
    except ValueError:
        return bad
    lists = ("evidence_gaps", "version_ambiguities", "reviewer_actions")
    if not isinstance(value, dict) or set(value) != {"change_interpretation", "impact_candidates", "review_status", *lists} or value["review_status"] != "REQUIRES_HUMAN_REVIEW":
        return bad
    reading, found = value["change_interpretation"], value["impact_candidates"]
    if not isinstance(reading, str) or len(reading) > 1000 or not isinstance(found, list) or len(found) > 5:
        return bad
    if not all(isinstance(c, dict) and set(c) == {"evidence_chunk_id", "reason", "suggested_action"} and _bounded(c["reason"], 1000) and _bounded(c["suggested_action"], 1000) for c in found):
        return bad
    names = [c["evidence_chunk_id"] for c in found]
    if not _names(names, 0, 5) or any(not isinstance(value[n], list) or len(value[n]) > 8 or not all(_bounded(t, 1000) for t in value[n]) for n in lists):
        return bad
    return {"valid": True, "candidates": names}


@F.pandas_udf(ANSWER)
def decoded_answer(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([answer_of(p) for p in x], columns=["valid", "claims", "cited", "final_answer"]).astype({"claims": "Int32"})


@F.pandas_udf(REVIEW)
def decoded_review(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([review_of(p) for p in x], columns=["valid", "candidates"])


def url_summary(url: Column) -> Column:
    """Scheme, host with a port that is named, and a hash of the path; only a hash of what is no HTTP address."""
    found = [F.regexp_extract(F.trim(url), r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(:\d+)?([^?#]*)", k) for k in range(1, 5)]
    good, none = found[1] != "", F.lit(None).cast("string")
    path = F.when(found[3] == "", "/").otherwise(found[3])
    return F.struct(
        F.when(good, "url").otherwise("invalid_url").alias("type"), F.when(good, F.lower(found[0])).otherwise(none).alias("scheme"), F.when(good, F.concat(F.lower(found[1]), found[2])).otherwise(none).alias("host"),
        F.when(good, F.sha2(path, 256)).otherwise(F.sha2(url, 256)).alias("sha256"),
    )


def _shown_url(match: re.Match) -> str:
    own = match[0].rstrip(".,);]")
    rest = match[0][len(own) :]
    try:
        parts = urlsplit(own)
        host = (parts.hostname or "") and parts.hostname.casefold() + (f":{parts.port}" if parts.port else "")
    except ValueError:
        host = ""
    if not host:
        return "[REDACTED_URL]" + rest
    return f"{parts.scheme.casefold()}://{host}{parts.path or '/'}{'?[REDACTED_QUERY]' if parts.query or parts.fragment else ''}{rest}"


_SECRET, _BEARER, _KEY = re.compile(SECRET_ASSIGNMENT), re.compile(BEARER), re.compile(KEY)


def safe_text_of(text: str, most: int = 500) -> str:
    """A text with addresses reduced to host and path, secrets replaced, and what is over `most` characters cut and named by its hash."""
    text = _KEY.sub("[REDACTED]", _BEARER.sub("Bearer [REDACTED]", _SECRET.sub(r"\1[REDACTED]", _URL.sub(_shown_url, text))))
    return text if len(text) <= most else f"{text[:most]}… [truncated sha256={hashlib.sha256(text.encode()).hexdigest()}]"


def safe_text(text: Column, most: int = 500) -> Column:
    return F.pandas_udf(lambda x: x.map(lambda t: safe_text_of(t, most), na_action="ignore"), StringType())(text)


def safe_value(value: Any, key: str | None = None, secret: frozenset[str] = frozenset({"apikey", "accesstoken", "authorization", "cookie", "password", "secret", "token"}), most: int = 500, items: int = 50) -> Any:
    """A nested value made safe: what stands under a secret's name goes, texts are made safe, lists end after `items` with the number left out."""
    name = re.sub(r"[^a-z0-9]", "", str(key or "").casefold())
    if name in secret or name.endswith(("apikey", "password", "secret", "token")):
        return "[REDACTED]"
    if isinstance(value, dict):
        return {k: safe_value(v, k, secret, most, items) for k, v in value.items()}
    if isinstance(value, list):
        rest = len(value) - items
        return [safe_value(v, None, secret, most, items) for v in value[:items]] + ([{"truncated_items": rest}] if rest > 0 else [])
    return safe_text_of(value, most) if isinstance(value, str) else value


@F.pandas_udf(StringType())
def safe_json(x: pd.Series) -> pd.Series:
    """A JSON text made safe, in canonical form; null and what is no JSON give null."""

    def safe(payload: str | None) -> str | None:
        own = canonical_json(payload)
        return None if own is None else json.dumps(safe_value(json.loads(own)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return x.map(safe)


def figure_notices(text: Column) -> Column:
    """Images in Markdown and HTML replaced by a notice with their label, which is not taken for what the image says."""
    out = F.regexp_replace(text, r"!\[\s*\]\([^)]*\)", F.lit("（原文配图「未命名配图」，图中文字未纳入检索；可在固定来源查看）"))
    out = F.regexp_replace(out, r"!\[\s*([^\]]*?)\s*\]\([^)]*\)", F.lit("（原文配图「$1」，图中文字未纳入检索；可在固定来源查看）"))
    out = F.regexp_replace(out, r"(?is)<img\b[^>]*?\balt\s*=\s*(['\"])\s*([^'\">]*?[^'\">\s])\s*\1[^>]*>", F.lit("（原文配图「$2」，图中文字未纳入检索；可在固定来源查看）"))
    return F.regexp_replace(out, r"(?i)<img\b[^>]*>", F.lit("（原文配图「未命名配图」，图中文字未纳入检索；可在固定来源查看）"))


def utc_minute(time: Column) -> Column:
    """A time as it is shown, to the minute; the session's time zone is UTC."""
    return F.date_format(time, "yyyy-MM-dd HH:mm 'UTC'")


def path_overlap(query: Column, *source: Column) -> Column:
    """How many different words of a query, of three letters or more and no stop words, the joined source holds when all but letters and digits is left out."""
    # Fixed value: words that say nothing about a path.
    stop = ["guide", "task", "docs", "official", "check", "verify", "and", "the", "what", "does", "how", "is", "for", "with", "parent", "child"]
    joined = F.regexp_replace(F.lower(F.concat_ws(" ", *(F.coalesce(s, F.lit("")) for s in source))), "[^a-z0-9]+", "")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("[a-z][a-z0-9]*"), F.lit(0)))
    return F.size(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop) & joined.contains(w)))
