"""Differences of full snapshots as they arrive, against the latest one in the store."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import diff
from siltstone.sources.store import Store

TRIGGERS = {"manual": {"availableNow": True}, "file_watch": {"processingTime": "5 seconds"}, "commit_count": {"availableNow": True}}


def trigger(mode: str, minutes: int = 30) -> dict:
    """The options of writeStream.trigger() for a mode of the settings."""
    return {"processingTime": f"{minutes} minutes"} if mode == "time_interval" else TRIGGERS[mode]


def watch(stream: DataFrame, store: Store, changes: str, checkpoint: str, mode: str = "manual", minutes: int = 30) -> StreamingQuery:
    """Writes the changes of each snapshot of a stream (project, snapshot_id, path, hash, size, lines) to a folder, by batch.

    A snapshot must arrive in one micro-batch. Snapshots of a batch are taken in the order of their ids. A batch that
    is run again writes the same partition again.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            compared(batch, store).write.mode("overwrite").parquet(f"{changes}/batch={number}")
            now = F.lit(datetime.now(timezone.utc)).cast("timestamp")
            taken = now + F.make_dt_interval(secs=F.col("n") / 1e6)
            store.save_snapshots(batch, _numbered(batch).select("project", "snapshot_id", taken.alias("taken_at"), F.lit(None).cast("string").alias("doc_id")))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger(mode, minutes)).start()


def _numbered(batch: DataFrame) -> DataFrame:
    """(project, snapshot_id, n, before): the snapshots of a batch in order, one row each."""
    w = Window.partitionBy("project").orderBy("snapshot_id")
    return batch.select("project", "snapshot_id").distinct().select("project", "snapshot_id", F.row_number().over(w).alias("n"), F.lag("snapshot_id").over(w).alias("before"))


def compared(batch: DataFrame, store: Store) -> DataFrame:
    """The changes of all snapshots of a batch in one plan, each against the one before it in the batch or the store's latest.

    Snapshots of the batch that the store has already, from a run that failed, don't count as earlier ones. The first
    snapshot of a project gives no changes.
    """
    order = _numbered(batch)
    headers = store.headers().join(order.select("project", "snapshot_id"), ["project", "snapshot_id"], "left_anti")
    last = headers.groupBy("project").agg(F.max_by("snapshot_id", F.struct("taken_at", "snapshot_id")).alias("_last"))
    firsts = order.where("n = 1").join(last, "project").select("project", F.col("_last").alias("before"), "snapshot_id")
    inner = order.where("n > 1").select("project", "before", "snapshot_id")
    cols = ["project", "snapshot_id", "path", "hash", "lines"]

    def moved(rows: DataFrame, to: DataFrame) -> DataFrame:
        """Rows under the id of the snapshot that they are compared with."""
        return rows.withColumnRenamed("snapshot_id", "before").join(to, ["project", "before"]).select(*cols)

    old = moved(batch, inner).unionByName(moved(store.snapshots(), firsts))
    known = inner.unionByName(firsts).select("project", "snapshot_id")
    return diff.compare(old, batch.join(known, ["project", "snapshot_id"], "left_semi").select(*cols), ["project", "snapshot_id", "path"])
