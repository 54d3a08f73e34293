"""Tables of snapshots and documents in a folder: appended, never rewritten.

A snapshot of a project is a partition of its own, written over as a whole if it is saved again. The
latest one is that of the greatest time among the headers, so there is no pointer that could
be left behind.
"""

from __future__ import annotations

import json
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siltstone.functions import text as T
from siltstone.operators.running import running
from siltstone.session import claim

SNAPSHOT = "project string, path string, hash string, size bigint, lines bigint, snapshot_id string"
HEADER = "project string, snapshot_id string, taken_at timestamp, doc_id string"
PENDING = "project string, session_id string, at timestamp, files_changed array<string>, summary string, magnitude double, flushed_at timestamp"
DOC = "project string, doc_id string, doc_ord bigint, path string, saved_at timestamp, session_type string, model string, files_analyzed bigint, content_hash string, content string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # snapshots

    def save_snapshot(self, snapshot: DataFrame, project: str, snapshot_id: str, taken_at: datetime, doc_id: str | None = None) -> None:
        own = snapshot.withColumn("project", F.lit(project)).withColumn("snapshot_id", F.lit(snapshot_id))
        self.save_snapshots(own, self.spark.createDataFrame([(project, snapshot_id, taken_at, doc_id)], HEADER))

    def save_snapshots(self, rows: DataFrame, headers: DataFrame) -> None:
        """Snapshots of any projects at once; a project's snapshot is written over if it is saved again, others aren't touched."""
        out = rows.select("path", "hash", "size", "lines", "project", "snapshot_id")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "snapshot_id").parquet(f"{self.root}/snapshot")
        self.save_headers(headers)

    def save_headers(self, headers: DataFrame) -> None:
        """Headers (project, snapshot_id, taken_at, doc_id) are appended; the one saved last holds."""
        headers.select(*[c.split()[0] for c in HEADER.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.root}/snapshots")

    def headers(self) -> DataFrame:
        """One header for each snapshot: the one saved last holds."""
        h = _read(self.spark, f"{self.root}/snapshots", HEADER)
        return h.groupBy("project", "snapshot_id").agg(F.max("taken_at").alias("taken_at"), F.max_by("doc_id", "taken_at").alias("doc_id"))

    def latest(self, project: str) -> str | None:
        row = self.headers().where(F.col("project") == project).agg(F.max_by("snapshot_id", F.struct("taken_at", "snapshot_id")).alias("s")).first()
        return row["s"] if row else None

    def latest_of_each(self) -> DataFrame:
        """(project, snapshot_id, taken_at): the latest snapshot of each project."""
        last = F.max(F.struct("taken_at", "snapshot_id")).alias("_l")
        return self.headers().groupBy("project").agg(last).select("project", "_l.snapshot_id", "_l.taken_at")

    def snapshots(self) -> DataFrame:
        """The rows of all snapshots, partitioned by project and snapshot_id."""
        return _read(self.spark, f"{self.root}/snapshot", SNAPSHOT)

    def load_snapshot(self, snapshot_id: str, project: str | None = None) -> DataFrame:
        """The rows of one snapshot, of one project or of all that have its id; other partitions aren't read."""
        own = self.snapshots().where(F.col("snapshot_id") == snapshot_id)
        return own if project is None else own.where(F.col("project") == project)

    def load_latest_snapshot(self, project: str) -> DataFrame | None:
        s = self.latest(project)
        return None if s is None else self.load_snapshot(s, project)

    # sessions held back

    def save_pending(self, project: str, session_id: str, at: datetime, files_changed: list[str], summary: str, magnitude: float) -> None:
        row = [(project, session_id, at, files_changed, summary, float(magnitude), None)]
        self.spark.createDataFrame(row, PENDING).coalesce(1).write.mode("append").parquet(f"{self.root}/pending")

    def load_pending(self, project: str) -> DataFrame:
        """The sessions held back since the last flush."""
        own = _read(self.spark, f"{self.root}/pending", PENDING).where(F.col("project") == project)
        flushed = own.agg(F.max("flushed_at").alias("_f"))
        return own.where("flushed_at is null").join(F.broadcast(flushed)).where(F.col("_f").isNull() | (F.col("at") > F.col("_f"))).drop("_f", "flushed_at")

    def flush(self, project: str, at: datetime) -> list[str]:
        """The summaries of the sessions held back, oldest first; they are held no more."""
        out = [r["summary"] for r in self.load_pending(project).orderBy("at", "session_id").select("summary").collect()]  # at most the limit of sessions
        self.spark.createDataFrame([(project, "flush", at, [], "", 0.0, at)], PENDING).coalesce(1).write.mode("append").parquet(f"{self.root}/pending")
        return out

    # documents

    def docs(self) -> DataFrame:
        return _read(self.spark, f"{self.root}/docs", DOC)

    def save_doc(self, project: str, content: str, saved_at: datetime, session_type: str, model: str, files_analyzed: int) -> str:
        """Append a document under the next number of its project; gives its id. Writers at one time get different numbers."""
        own = self.docs().where(F.col("project") == project)
        n = (own.agg(F.max("doc_ord").alias("n")).first()["n"] or 0) + 1
        while not claim(self.spark, f"{self.root}/numbers/{quote(project, safe='')}/{n}"):
            n += 1
        doc_id = f"pd_{n:03d}"
        row = [(project, doc_id, n, f"docs/{doc_id}.md", saved_at, session_type, model, files_analyzed, content)]
        df = self.spark.createDataFrame(row, "project string, doc_id string, doc_ord bigint, path string, saved_at timestamp, session_type string, model string, files_analyzed bigint, content string")
        df.withColumn("content_hash", T.content_hash16(F.col("content"))).select(*[c.split()[0] for c in DOC.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.root}/docs")
        return doc_id

    def load_all_docs(self, project: str) -> DataFrame:
        """(doc_ord, doc_id, content) in the order of saving; sort by doc_ord to read it so."""
        return self.docs().where((F.col("project") == project) & F.col("content").isNotNull()).select("project", "doc_ord", "doc_id", "content")

    def get_doc(self, project: str, doc_id: str) -> DataFrame:
        return self.docs().where((F.col("project") == project) & (F.col("doc_id") == doc_id))


def numbered(docs: DataFrame, order: list[str], by: str = "project") -> DataFrame:
    """docs with doc_ord from 1, doc_id and the state of merging after each: pending for the first, then stale."""
    return running(docs, [by], order).withColumnRenamed("row_number", "doc_ord").withColumn("doc_id", F.format_string("pd_%03d", "doc_ord")).withColumn("merge_state", F.when(F.col("doc_ord") > 1, "stale").otherwise("pending"))


def manifest(docs: DataFrame, by: str = "project") -> DataFrame:
    """(by, total_docs, last_doc_id, merge_state)."""
    return docs.groupBy(by).agg(F.count("*").alias("total_docs"), F.max_by("doc_id", "doc_ord").alias("last_doc_id")).withColumn("merge_state", F.when(F.col("total_docs") > 1, "stale").otherwise("pending"))


def to_json_rows(df: DataFrame, rounded: dict[str, int] | None = None) -> DataFrame:
    """(value): each row as JSON, some columns rounded."""
    for c, n in (rounded or {}).items():
        df = df.withColumn(c, F.round(c, n))
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def from_json_rows(df: DataFrame, schema: str) -> DataFrame:
    """Rows of to_json_rows() by an explicit schema; a missing field is null."""
    return df.select(F.from_json("value", schema).alias("r")).select("r.*")


def pretty(obj: object) -> str:
    return json.dumps(obj, indent=2)
