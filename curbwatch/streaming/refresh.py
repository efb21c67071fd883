"""Refresh on change: re-read a collection (and recompute reports) when a
change feed reports a data change.

The change feed is a streaming DataFrame of change records with an
``operationType`` column (a change-stream connector, a Kafka topic, or
recorded JSON files). Only insert, update, replace and delete trigger a
refresh; other operations (drop, rename, ...) are ignored. A micro-batch
holding any number of relevant changes triggers one refresh: a full re-read
of the snapshot, or with ``incremental`` one of the files that changed.

A *keyed* feed also tells the document and the place of each change in the
feed (``KEYED_CHANGE_SCHEMA``). Feeds deliver at least once; with a key and a
place, records that were seen before can be told (``new_changes``) and, out of
order as they may come, only the last state of a document counts
(``last_changes``).

A report is published by a pointer: its rows are written to a folder of their
own, and then a small file that names the folder is replaced in one step. A
reader gets the old report or the new one; a replayed batch that is older than
the published one of its query never takes its place.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..schema import REFRESH_OPERATIONS
from ..sources.collections import CollectionRegistry
from ..sources.shared_files import SharedFiles
from .incremental import IncrementalReport
from .ingest import run_key

CHANGE_SCHEMA = StructType([StructField("operationType", StringType(), True)])

# documentKey names the document, position is the change's place in the feed
KEYED_CHANGE_SCHEMA = StructType(
    [*CHANGE_SCHEMA.fields, StructField("documentKey", StringType(), True), StructField("position", LongType(), True)]
)


def read_changes(
    spark: SparkSession,
    format: str = "json",
    path: str | None = None,
    schema: StructType | None = CHANGE_SCHEMA,
    **options: str,
) -> DataFrame:
    """A streaming DataFrame of change records."""
    reader = spark.readStream.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path is not None else reader.load()


def relevant_changes(changes: DataFrame) -> DataFrame:
    """Change records that call for a refresh."""
    return changes.filter(F.col("operationType").isin(*REFRESH_OPERATIONS))


def new_changes(changes: DataFrame, within: int | None = None) -> DataFrame:
    """The relevant records of a keyed feed, each once: repeats by key and position are dropped, in a stream
    against what came before. ``within`` bounds what the stream remembers: records more than that many
    positions behind the latest count as repeats (None: all are remembered). Records without key or
    position can't be recognised and are all kept."""
    relevant = relevant_changes(changes)
    known = relevant.where("documentKey is not null AND position is not null")
    names = ["documentKey", "position"]
    if within is None:
        once = known.dropDuplicates(names)
    else:  # a position as a time, for the watermark
        timed = known.withColumn("_at", F.timestamp_seconds("position")).withWatermark("_at", f"{within} seconds")
        once = timed.dropDuplicatesWithinWatermark(names) if changes.isStreaming else timed.dropDuplicates(names)
        once = once.drop("_at")
    return once.unionByName(relevant.where("documentKey is null OR position is null"))


def last_changes(changes: DataFrame) -> DataFrame:
    """Of each document of a keyed feed its last relevant record by position, in whatever order they come
    (batch only; repeats are one record). One partial row per key and task, so a document that changes all the
    time is no hot key."""
    known = relevant_changes(changes).where("documentKey is not null AND position is not null")
    others = [F.col(c) for c in changes.columns if c not in ("documentKey", "position")]
    last = F.max(F.struct("position", *others)).alias("last")
    return known.groupBy("documentKey").agg(last).select("documentKey", "last.*").select(changes.columns)


class Watch:
    """A refresh query that can end after the batch it is at.

    ``stop`` cancels a running batch, which is then done again at the next
    start. ``drain`` lets it end: batches run under a lock, so taking it means
    that none is at work; a batch that would begin afterwards is refused and
    left for the next start.
    """

    def __init__(self) -> None:
        self.query: StreamingQuery | None = None
        self._lock = threading.Lock()
        self._ending = False

    def guarded(self, handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def run(batch: DataFrame, batch_id: int) -> None:
            with self._lock:
                if self._ending:
                    raise InterruptedError("the watch is being drained")
                handle(batch, batch_id)

        return run

    def drain(self, timeout: float = 600.0) -> None:
        """End the query once the batch it is at, if any, is done and committed."""
        query, until = self.query, time.monotonic() + timeout
        if query is None or not query.isActive:
            return
        if not self._lock.acquire(timeout=timeout):
            raise TimeoutError("the running batch did not end in time")
        self._ending = True
        self._lock.release()
        # the handler is done; the query writes its commit entry and goes on to its next trigger
        while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
            time.sleep(0.02)
        query.stop()


def start_refresh(
    changes: DataFrame,
    on_change: Callable[[int], None],
    checkpoint_location: str,
    *,
    trigger: Mapping[str, Any] | None = None,
    query_name: str | None = None,
    watch: Watch | None = None,
) -> StreamingQuery:
    """Call ``on_change(batch_id)`` once for every micro-batch that holds at
    least one relevant change (of a keyed feed: one not seen before). Of a
    feed without keys only a one-row probe of the batch is read."""
    if not checkpoint_location:
        raise ValueError("a checkpoint location is required")

    keyed = {"documentKey", "position"} <= set(changes.columns)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # what the stream remembers is brought up to date by reading the whole batch
        if batch.count() > 0 if keyed else not batch.isEmpty():
            on_change(batch_id)

    relevant = new_changes(changes) if keyed else relevant_changes(changes)
    writer = (
        relevant.select("operationType")
        .writeStream.option("checkpointLocation", checkpoint_location)
        .foreachBatch(watch.guarded(handle) if watch else handle)
    )
    if trigger:
        writer = writer.trigger(**trigger)
    if query_name:
        writer = writer.queryName(query_name)
    query = writer.start()
    if watch:
        watch.query = query
    return query


def write_report(report: DataFrame, path: str, batch_id: int, format: str = "parquet") -> bool:
    """Write one refresh's report to ``{path}/history/query=<id>/batch_id=<n>``
    (overwrite: a replayed batch replaces its own output) and publish it;
    False if a later batch of the query was published already."""
    spark = report.sparkSession
    base, key = path.rstrip("/"), run_key(spark)
    folder = f"history/query={key}/batch_id={batch_id}"
    published = _published(spark, base)
    last = published.get("last", {})
    if batch_id < last.get(key, -1):
        return False  # the report of this replayed batch stands as it was written then
    if published.get("folder") != folder or not SharedFiles(spark).exists(f"{base}/{folder}/_SUCCESS"):
        report.write.format(format).mode("overwrite").save(f"{base}/{folder}")
    pointer = {"folder": folder, "last": {**last, key: batch_id}}
    SharedFiles(spark).replace(f"{base}/current.json", json.dumps(pointer))
    return True


def _published(spark: SparkSession, base: str) -> dict[str, Any]:
    return json.loads(SharedFiles(spark).read(f"{base}/current.json") or "{}")


def latest_report(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Rows of the report published last, by whichever query: one read of one
    folder, however many reports there were. A DataFrame that was got before
    the next report is published goes on to show its own."""
    base = path.rstrip("/")
    folder = _published(spark, base).get("folder")
    if folder is None:
        raise FileNotFoundError(f"no report was published below {path}")
    return spark.read.format(format).load(f"{base}/{folder}")


def report_history(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Rows of every report, with the columns ``query`` and ``batch_id``."""
    return spark.read.format(format).load(f"{path.rstrip('/')}/history")


def watch_collection(
    registry: CollectionRegistry,
    name: str,
    changes: DataFrame,
    checkpoint_location: str,
    *,
    report: Callable[[DataFrame], DataFrame] | None = None,
    report_path: str | None = None,
    incremental: IncrementalReport | None = None,
    trigger: Mapping[str, Any] | None = None,
) -> StreamingQuery:
    """Refresh collection ``name`` on relevant changes; optionally recompute
    ``report(df)`` over the new snapshot and publish it under ``report_path``,
    or with ``incremental`` in place of ``report`` bring that report up to
    date from the files that changed. The query is attached to the registry,
    so ``remove``/``stop_all`` stop it and ``drain`` lets it end.
    """
    if report is not None and incremental is not None:
        raise ValueError("either a report or an incremental one")
    if (report is None and incremental is None) != (report_path is None):
        raise ValueError("report (or incremental) and report_path go together")

    def on_change(batch_id: int) -> None:
        df = registry.refresh(name)
        if incremental is not None:
            write_report(incremental.refresh(df), report_path, batch_id)
        elif report is not None:
            write_report(report(df), report_path, batch_id)

    watch = Watch()
    query = start_refresh(changes, on_change, checkpoint_location, trigger=trigger, query_name=None, watch=watch)
    registry.attach_watch(name, query, watch.drain)
    return query
