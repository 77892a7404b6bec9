"""Scopes of retrieval: which versions, documents, items, evidence and figures a request may see."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """A conjunction of allowed values; an empty list allows all. Checked when made, before any plan is built.

    Values are NFKC-normalised with blanks collapsed; blank or repeated ones, and named versions with `active_only`, are errors.
    """

    project_ids: tuple[str, ...] = ()
    document_ids: tuple[str, ...] = ()
    document_types: tuple[str, ...] = ()
    version_ids: tuple[str, ...] = ()
    organization_ids: tuple[str, ...] = ()
    active_only: bool = True

    def __post_init__(self) -> None:
        for name, values in asdict(self).items():
            if name == "active_only":
                continue
            own = tuple(re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v)).strip() for v in values)
            if not all(own) or len(set(own)) < len(own):
                raise ValueError(f"{name}: values must not be blank or repeated")
            object.__setattr__(self, name, own)
        if self.version_ids and self.active_only:
            raise ValueError("named versions need active_only=False")

    def allows(self, **columns: Column) -> Column:
        """The predicate over the given columns, named as the scope's lists; a null is in no non-empty list."""
        out = F.lit(True)
        for name, column in columns.items():
            if values := getattr(self, name):
                out = out & F.coalesce(column.isin(*values), F.lit(False))
        return out

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def version_members(version: str, known: set[str], current: str, composites: dict[str, list[str]] | None = None) -> set[str] | None:
    """The versions a scope name stands for: `current`, a composite, an exact one; None for `all`; anything else is an error."""
    name = current if version == "current" else version
    if name == "all":
        return None
    if name in (composites or {}):
        members = composites[name]
        if not members or not set(members) <= known:
            raise ValueError(f"scope {name} names unknown versions")
        return set(members)
    if name not in known:
        raise ValueError(f"unknown version scope {version}")
    return {name}


def in_versions(df: DataFrame, members: set[str] | None, version: str = "version") -> DataFrame:
    return df if members is None else df.where(F.col(version).isin(*sorted(members)))


def catalog_scope(chunks: DataFrame, catalog: DataFrame, scope: Scope, document: str = "document_id") -> DataFrame:
    """Chunks whose version (catalog: document_id, version_id, project_id, document_type, status) is in the scope, joined on `document`; chunks the catalog does not know are out."""
    allowed = scope.allows(project_ids=F.col("project_id"), document_types=F.col("document_type"), version_ids=F.col("version_id"), document_ids=F.col("document_id"))
    rows = catalog.where(allowed & ((F.col("status") == "ACTIVE") if scope.active_only else F.lit(True)))
    return chunks.join(rows.select(document).distinct(), document, "left_semi")


def evidence_scope(evidence: DataFrame, scope: Scope) -> DataFrame:
    """Evidence (project_id, document_id, document_type, version_id, version_status) in the scope; evidence without a version need not be active."""
    allowed = scope.allows(**{f"{n}s": F.col(n) for n in ("project_id", "document_id", "document_type", "version_id") if n in evidence.columns})
    active = F.col("version_id").isNull() | F.coalesce(F.col("version_status") == "ACTIVE", F.lit(False)) if scope.active_only else F.lit(True)
    return evidence.where(allowed & active)


def one_for_each(rows: DataFrame, keys: list[str], language: str, order: list[str], wanted: str = "zh", other: str = "en") -> DataFrame:
    """One row for each key: the last in the preferred language, else the first of any. The wanted language is preferred if any row has it, else the other."""
    any_wanted = rows.agg(F.max(F.coalesce(F.col(language) == wanted, F.lit(False))).alias("_any"))
    own = rows.crossJoin(F.broadcast(any_wanted)).withColumn("_own", F.coalesce(F.col(language) == F.when(F.col("_any"), wanted).otherwise(other), F.lit(False)))  # one row
    at = F.struct(*order)
    first, last = F.min_by(F.struct(*rows.columns), at), F.max_by(F.when(F.col("_own"), F.struct(*rows.columns)), F.when(F.col("_own"), at))
    return own.groupBy(*keys).agg(F.coalesce(last, first).alias("_r")).select("_r.*")


def document_rows(chunks: DataFrame, document_id: str) -> DataFrame:
    """All chunks of one document; a document without any is an error."""
    rows = chunks.where(F.col("document_id") == document_id)
    if rows.isEmpty():
        raise LookupError(document_id)
    return rows


def safe_trace(hits: DataFrame, pages: tuple[str, ...] = ("page", "page_number")) -> DataFrame:
    """Hits without their texts: only names, places and scores."""
    page = [F.col(p) for p in pages if p in hits.columns]
    kept = [c for c in ("query_id", "rank", "chunk_id", "document_id", "version", "score") if c in hits.columns]
    return hits.select(*kept, *([F.coalesce(*page).alias("page")] if page else []))


def first_kept(rows: DataFrame, order: str, *keys: list[str]) -> DataFrame:
    """Rows of which no earlier one has the same first keys, then of those left none the same second keys, and so on."""
    for key in keys:
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_nth = 1").drop("_nth")
    return rows
