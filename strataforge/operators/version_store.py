"""A store of document versions: ingest, activate, check and search, each refresh published by one pointer.

A refresh adds its own sections and vectors as folders beside the earlier ones and writes the small table of versions anew; readers take
what is numbered up to the pointer, so a refresh that failed half-way is never seen, and its number is written over by the next.
Vectors are kept by content, once for the whole store. Many documents may be ingested at once, one version of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..plans.tables import written
from ..sources.files import point, pointed
from .lifecycle import diff_summary, keyed_diff
from .retrieval import dot, ranked
from .scopes import Scope, catalog_scope

VERSIONS = "document_id string, version_id string, project_id string, document_type string, source_hash string, status string, previous_version_id string, refresh int"
SECTIONS = "version_id string, document_id string, section_path string, position int, content string, content_hash string"
VECTORS = "content_hash string, vector array<float>"


class VersionStore:
    """`encode` makes the vector of a content column; vectors are expected at unit length."""

    def __init__(self, spark: SparkSession, root: str, encode):
        self.spark, self.root, self.encode = spark, root, encode

    def _read(self, name: str, schema: str) -> DataFrame:
        """The rows of all refreshes up to the pointer; of the versions those of the pointer's own."""
        refresh = pointed(self.spark, self.root)
        if refresh is None:
            return self.spark.createDataFrame([], schema)
        first = refresh if name == "versions" else 1
        paths = [f"{self.root}/{name}/refresh-{n}" for n in range(first, refresh + 1)]
        hadoop, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        there = [p for p in paths if hadoop.Path(p).getFileSystem(conf).exists(hadoop.Path(p))]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    @property
    def versions(self) -> DataFrame:
        return self._read("versions", VERSIONS)

    @property
    def sections(self) -> DataFrame:
        return self._read("sections", SECTIONS)

    @property
    def vectors(self) -> DataFrame:
        return self._read("vectors", VECTORS)

    @property
    def active(self) -> DataFrame:
        """Sections of active versions."""
        return self.sections.join(self.versions.where("status = 'ACTIVE'").select("version_id"), "version_id", "left_semi")

    @staticmethod
    def _refuse(wrong: DataFrame, why: str) -> None:
        if row := wrong.first():
            raise ValueError(f"{why}: {row.asDict()}")

    def ingest(self, versions: DataFrame, sections: DataFrame, activate: bool = True) -> DataFrame:
        """Add versions (document_id, version_id, project_id, document_type, source_hash) with their sections (version_id, section_path, position, content).

        Returns for each document the sections unchanged, modified, added and removed against its active version, and how many of its
        contents had a vector already. Refused, with nothing changed: a known version, a source a document has already, two versions
        of one document, a version without sections, a section path twice.
        """
        number = (pointed(self.spark, self.root) or 0) + 1
        new = written(versions.select("document_id", "version_id", "project_id", "document_type", "source_hash"))
        known = self.versions
        self._refuse(new.join(known, "version_id", "left_semi"), "version exists")
        self._refuse(new.join(known, ["document_id", "source_hash"], "left_semi"), "source was ingested before")
        self._refuse(new.groupBy("document_id").count().where("count > 1"), "several versions of a document")
        stable = known.select("document_id", F.col("project_id").alias("p"), F.col("document_type").alias("t")).distinct()
        self._refuse(new.join(stable, "document_id").where("not (p <=> project_id and t <=> document_type)"), "project or type of a document changed")
        rows = sections.join(new.select("version_id", "document_id"), "version_id")
        rows = written(rows.select("version_id", "document_id", "section_path", F.col("position").cast("int").alias("position"), "content", content_hash(F.col("content")).alias("content_hash")))
        self._refuse(new.join(rows, "version_id", "left_anti"), "no sections")
        self._refuse(rows.groupBy("version_id", "section_path").count().where("count > 1"), "section path twice")

        old = self.active.join(new.select("document_id"), "document_id", "left_semi")
        changes = keyed_diff(old, rows, ["document_id", "section_path"], "content_hash")
        contents = rows.groupBy("content_hash").agg(F.min("content").alias("content"))
        missing = written(contents.join(self.vectors, "content_hash", "left_anti"))
        fresh = rows.join(missing.select("content_hash"), "content_hash", "left_semi").groupBy("document_id").agg(F.countDistinct("content_hash").alias("new_vectors"))
        report = diff_summary(changes, ["document_id"]).join(fresh, "document_id", "left")
        report = written(report.select("document_id", "unchanged", "modified", "added", "removed", F.coalesce("new_vectors", F.lit(0)).alias("new_vectors")))

        rows.write.mode("overwrite").parquet(f"{self.root}/sections/refresh-{number}")
        missing.select("content_hash", self.encode(F.col("content")).alias("vector")).write.mode("overwrite").parquet(f"{self.root}/vectors/refresh-{number}")
        before = known.where("status = 'ACTIVE'").select("document_id", F.col("version_id").alias("previous_version_id"))
        added = new.join(before, "document_id", "left").select(*new.columns, F.lit("ACTIVE" if activate else "SUPERSEDED").alias("status"), "previous_version_id", F.lit(number).alias("refresh"))
        if activate:
            touched = new.select("document_id", F.lit(True).alias("_new"))
            known = known.join(touched, "document_id", "left").withColumn("status", F.when(F.col("_new"), "SUPERSEDED").otherwise(F.col("status"))).drop("_new")
        self._publish(known.unionByName(added), number)
        return report

    def activate(self, version_id: str) -> None:
        """Make one version its document's active one; the others are superseded."""
        own = self.versions.where(F.col("version_id") == version_id).select(F.col("document_id").alias("_own"))
        if own.isEmpty():
            raise LookupError(version_id)
        status = F.when(F.col("_own").isNull(), F.col("status")).when(F.col("version_id") == version_id, "ACTIVE").otherwise("SUPERSEDED")
        rows = self.versions.join(F.broadcast(own), F.col("document_id") == F.col("_own"), "left").withColumn("status", status).drop("_own")  # one row
        self._publish(rows, pointed(self.spark, self.root) + 1)

    def _publish(self, versions: DataFrame, number: int) -> None:
        columns = [part.split()[0] for part in VERSIONS.split(", ")]
        versions.select(*columns).write.mode("overwrite").parquet(f"{self.root}/versions/refresh-{number}")
        point(self.spark, self.root, number)

    def faults(self) -> DataFrame:
        """(fault, name): what breaks the store's rules; empty for a whole one."""
        versions, sections, vectors = self.versions, self.sections, self.vectors
        norm = F.sqrt(dot("vector", "vector"))
        found = [
            ("several active versions", versions.where("status = 'ACTIVE'").groupBy("document_id").count().where("count > 1").select("document_id")),
            ("version without sections", versions.join(sections, "version_id", "left_anti").select("version_id")),
            ("sections of no version", sections.join(versions, "version_id", "left_anti").select("version_id").distinct()),
            ("content hash does not fit", sections.where(content_hash(F.col("content")) != F.col("content_hash")).select("version_id").distinct()),
            ("no vector", sections.join(vectors, "content_hash", "left_anti").select("content_hash").distinct()),
            ("vector is not of unit length", vectors.where(F.isnan(norm) | (F.abs(norm - 1) > 1e-4)).select("content_hash")),
            ("vector of another dimension", vectors.where(F.size("vector") != F.lit(self._dimension(vectors))).select("content_hash")),
        ]
        out = None
        for fault, rows in found:
            part = rows.select(F.lit(fault).alias("fault"), F.col(rows.columns[0]).alias("name"))
            out = part if out is None else out.union(part)
        return out

    @staticmethod
    def _dimension(vectors: DataFrame) -> int:
        row = vectors.select(F.size("vector")).first()
        return row[0] if row else 0

    def search(self, queries: DataFrame, scope: Scope, k: int) -> DataFrame:
        """(query_id, version_id, position, score, rank): exact best k sections in the scope for a stated set of queries (query_id, vector); ties by version and position."""
        rows = catalog_scope(self.sections, self.versions, scope, "version_id")
        scored = rows.join(self.vectors, "content_hash").crossJoin(queries.select("query_id", F.col("vector").alias("_query")))
        scored = scored.select("query_id", "version_id", "position", F.round(dot("vector", "_query"), 6).alias("score"))
        return ranked(scored, [F.desc("score"), F.asc("version_id"), F.asc("position")], k)

