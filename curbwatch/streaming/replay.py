"""Replay feeds derived from the ``events`` table through the streaming paths.

Each function takes ``(spark, sf_dir)``, records a feed derived from
``{sf_dir}/events.parquet`` under the shared checkpoint folder, runs the
streaming query over it to completion (``availableNow``) and returns what
the query wrote, as a DataFrame.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fine_report import fine_counts, fine_report_rows
from ..operators.master_report import master_report_rows
from ..schema import DETECTIONS_SCHEMA, REFRESH_OPERATIONS, STREAM_SCHEMA
from ..session import shared_dir
from ..sources.collections import CollectionRegistry
from ..sources.detections import load_detections
from ..sources.messages import payloads_from_events
from ..sources.shared_files import SharedFiles
from .batches import BatchList
from .incremental import IncrementalReport
from .ingest import BatchSink, decode_messages, read_messages, sink_rows, start_ingest
from .refresh import KEYED_CHANGE_SCHEMA, read_changes, report_history

AVAILABLE_NOW = {"availableNow": True}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads derived from events, decoded (batch form of the decode)."""
    return decode_messages(payloads_from_events(_events(spark, sf_dir)))


def _ingest(spark: SparkSession, inbox: str, sink: BatchSink, checkpoint: str) -> None:
    messages = read_messages(spark, "text", inbox)
    start_ingest(messages, sink, checkpoint, trigger=AVAILABLE_NOW).awaitTermination()


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record payloads as text files, ingest them with the streaming
    pipeline into a per-batch parquet sink, run it a second time on the same
    checkpoint (adds nothing), and return the sink's rows."""
    root = shared_dir(spark, "stream_ingest")
    payloads_from_events(_events(spark, sf_dir)).write.mode("error").text(f"{root}/inbox")
    for _ in range(2):
        _ingest(spark, f"{root}/inbox", BatchSink("parquet", f"{root}/sink"), f"{root}/checkpoint")
    return sink_rows(spark, f"{root}/sink")


def _two_feeds(spark: SparkSession, sf_dir: str, root: str, sink: BatchSink) -> None:
    """Two halves of the events as feeds with a checkpoint each, into one sink;
    the second feed's query runs twice."""
    events = _events(spark, sf_dir)
    odd = F.coalesce(F.col("event_id") % 2 != 0, F.lit(False))
    for feed, part in (("even", events.where(~odd)), ("odd", events.where(odd))):
        payloads_from_events(part).write.mode("error").text(f"{root}/{feed}")
    for feed in ("even", "odd", "odd"):
        _ingest(spark, f"{root}/{feed}", sink, f"{root}/checkpoint_{feed}")


def stream_ingest_two_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds with a checkpoint each into one path sink: all rows of both."""
    root = shared_dir(spark, "stream_ingest_two_feeds")
    _two_feeds(spark, sf_dir, root, BatchSink("parquet", f"{root}/sink"))
    return sink_rows(spark, f"{root}/sink")


def stream_ingest_two_feeds_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same into one connector-style sink (append) with a commit log."""
    root = shared_dir(spark, "stream_ingest_two_feeds_log")
    sink = BatchSink("parquet", commit_log=f"{root}/log", options={"path": f"{root}/sink"})
    _two_feeds(spark, sf_dir, root, sink)
    return spark.read.parquet(f"{root}/sink").drop("query_id", "batch_id")


# the change each run of the feed tells of; the last one calls for no refresh
CHANGE_RUNS = (*REFRESH_OPERATIONS, "drop")


def refresh_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the detections collection and its fine report fresh from a
    change feed derived from events.

    The events are dealt over as many parts as there are runs. Each run first
    adds a part to the stored collection, then feeds one kind of change record
    (one per event of the part) through the watch: every relevant kind must
    give a new report over all parts so far, read from the new files; the last
    kind is ignored, so the last part must not show up. Returns all reports:
    ``sequence`` (from 1), ``metric``, ``id`` and ``value``.
    """
    root = shared_dir(spark, "refresh_on_change")
    collection, reports = f"{root}/DETECTIONS", f"{root}/reports"
    detections = load_detections(spark, sf_dir)
    events = _events(spark, sf_dir)
    registry = CollectionRegistry(spark, format="parquet")
    for run, operation in enumerate(CHANGE_RUNS):
        part = F.pmod(F.col("event_id"), F.lit(len(CHANGE_RUNS))) == run
        stored = F.pmod(F.col("ID").cast("long"), F.lit(len(CHANGE_RUNS))) == run
        detections.where(stored).write.mode("append").parquet(collection)
        registry.add("DETECTIONS", DETECTIONS_SCHEMA, path=collection)
        records = events.where(part).select(F.lit(operation).alias("operationType"))
        records.write.mode("append").json(f"{root}/changes")
        changes = read_changes(spark, "json", f"{root}/changes")
        query = registry.watch(
            "DETECTIONS", changes, f"{root}/checkpoint", report=fine_counts, report_path=reports, trigger=AVAILABLE_NOW
        )
        query.awaitTermination()
    registry.remove("DETECTIONS")
    return report_history(spark, reports).select((F.col("batch_id") + 1).alias("sequence"), "metric", "id", "value")


class _DiesOnce(BatchSink):
    """A connector sink whose first batch stops after half of its rows."""

    def _append(self, rows: DataFrame) -> None:
        super()._append(rows.where(F.pmod(F.xxhash64(*STREAM_SCHEMA.names), F.lit(2)) == 0))
        raise ConnectionError("the job died while it was writing a batch")


def stream_ingest_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connector sink whose job dies half way through its first batch, before the log tells of a commit;
    restarted, it finds the intent, looks up what is there and appends what is missing. All rows once."""
    root = shared_dir(spark, "stream_ingest_settled")
    payloads_from_events(_events(spark, sf_dir)).write.mode("error").text(f"{root}/inbox")
    settings = {"commit_log": f"{root}/log", "options": {"path": f"{root}/sink"}}
    try:
        _ingest(spark, f"{root}/inbox", _DiesOnce("parquet", **settings), f"{root}/checkpoint")
    except StreamingQueryException:
        pass  # as planned
    for _ in range(2):
        _ingest(spark, f"{root}/inbox", BatchSink("parquet", **settings), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/sink").drop("query_id", "batch_id")


def stream_ingest_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of twelve files as a batch each, compacted half way and at the end, cleaned, and run once more."""
    root = shared_dir(spark, "stream_ingest_compacted")
    sink, batches = BatchSink("parquet", f"{root}/sink"), BatchList(spark, f"{root}/sink")
    payloads = payloads_from_events(_events(spark, sf_dir))
    for half in range(2):
        own = F.pmod(F.xxhash64("value"), F.lit(2)) == half
        payloads.where(own).repartition(6).write.mode("append").text(f"{root}/inbox")
        for _ in range(2):
            messages = read_messages(spark, "text", f"{root}/inbox", maxFilesPerTrigger="1")
            start_ingest(messages, sink, f"{root}/checkpoint", trigger=AVAILABLE_NOW).awaitTermination()
        batches.compact(STREAM_SCHEMA, fan_in=3)
        batches.clean()
    return sink_rows(spark, f"{root}/sink", schema=STREAM_SCHEMA)


def collection_lookup_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fine counts of a collection got before rows are added to it (``step`` 1) and after (2). Both are
    computed after, so the first shows the files that were there when it was got."""
    root = shared_dir(spark, "collection_lookup_fresh")
    path = f"{root}/DETECTIONS"
    detections = load_detections(spark, sf_dir)
    odd = F.col("ID").cast("long") % 2 != 0
    detections.where(~odd).write.parquet(path)
    registry = CollectionRegistry(spark, format="parquet")
    registry.add("DETECTIONS", DETECTIONS_SCHEMA, path=path)
    steps = [registry.get("DETECTIONS")]
    detections.where(odd).write.mode("append").parquet(path)
    steps.append(registry.get("DETECTIONS"))
    for i, df in enumerate(steps):  # a query each: within one, Spark takes two reads of a path for the same
        fine_counts(df).select(F.lit(i + 1).alias("step"), "*").write.mode("append").parquet(f"{root}/counts")
    return spark.read.parquet(f"{root}/counts")


def reports_one_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both reports' rows over one snapshot of a batch sink (``step`` 1) and over the next one (2). Between
    the two a batch is written; a batch that was never finished lies there all the time."""
    root = shared_dir(spark, "reports_one_snapshot")
    detections, steps = load_detections(spark, sf_dir), []
    registry = CollectionRegistry(spark, format="parquet")
    detections.limit(100).write.parquet(f"{root}/sink/query=dead/batch_id=0")  # not in the list: half written
    for half in range(2):
        detections.where(F.col("ID").cast("long") % 2 == half).write.mode("append").parquet(f"{root}/inbox")
        rows = spark.readStream.schema(DETECTIONS_SCHEMA).parquet(f"{root}/inbox")
        writer = rows.writeStream.option("checkpointLocation", f"{root}/checkpoint")
        writer = writer.foreachBatch(BatchSink("parquet", f"{root}/sink")).trigger(**AVAILABLE_NOW)
        writer.start().awaitTermination()
        registry.add("DETECTIONS", DETECTIONS_SCHEMA, path=f"{root}/sink", batches=True) if half == 0 else None
        steps.append(registry.get("DETECTIONS"))
    out = None
    for i, df in enumerate(steps):
        for report, rows in (("fine", fine_report_rows(df)), ("master", master_report_rows(df))):
            rows = rows.select(F.lit(i + 1).alias("step"), F.lit(report).alias("report"), "section", "name", "value")
            out = rows if out is None else out.union(rows)
    return out


def refresh_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fine report kept up to date from the files that change: an insert, an update of one part's rows, a
    part replaced by another, a part deleted, and an insert. Returns the report after each (``sequence``)."""
    root = shared_dir(spark, "refresh_incremental")
    collection = f"{root}/DETECTIONS"
    detections, files = load_detections(spark, sf_dir), SharedFiles(spark)
    part = [detections.where(F.col("ID").cast("long") % 4 == i) for i in range(4)]

    def put(name: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{collection}/part={name}")

    def first() -> None:
        put(0, part[0])
        put(1, part[1])

    steps = [
        ("insert", first),
        ("update", lambda: put(1, part[1].withColumn("FINE_TYPE", F.lit(88)))),
        ("replace", lambda: put(0, part[2])),
        ("delete", lambda: files.delete(f"{collection}/part=1")),
        ("insert", lambda: put(3, part[3])),
    ]
    registry = CollectionRegistry(spark, format="parquet")
    for operation, change in steps:
        change()
        registry.add("DETECTIONS", DETECTIONS_SCHEMA, path=collection)
        report = IncrementalReport(spark, lambda: registry.roots("DETECTIONS"), DETECTIONS_SCHEMA, f"{root}/state")
        spark.createDataFrame([(operation,)], "operationType string").write.mode("append").json(f"{root}/changes")
        changes = read_changes(spark, "json", f"{root}/changes")
        registry.watch(
            "DETECTIONS", changes, f"{root}/checkpoint", incremental=report, report_path=f"{root}/reports", trigger=AVAILABLE_NOW
        ).awaitTermination()
    registry.remove("DETECTIONS")
    return report_history(spark, f"{root}/reports").select((F.col("batch_id") + 1).alias("sequence"), "section", "name", "value")


def refresh_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed change feed that delivers records again and out of order. The events are dealt over three runs:
    the second delivers the first's records once more, so it asks for no report; the third brings new ones
    among repeats. Returns the reports by run (``sequence``): 1, over the first part, and 3, over all."""
    root = shared_dir(spark, "refresh_keyed")
    collection, detections, events = f"{root}/DETECTIONS", load_detections(spark, sf_dir), _events(spark, sf_dir)
    registry = CollectionRegistry(spark, format="parquet")
    records = events.select(
        F.lit("insert").alias("operationType"), F.col("event_id").cast("string").alias("documentKey"), F.col("event_id").alias("position")
    )
    part = F.pmod(F.col("position"), F.lit(3))
    for run, delivered in enumerate((part == 0, part == 0, part < 3)):
        detections.where(F.col("ID").cast("long") % 3 == run).write.mode("append").parquet(collection)
        registry.add("DETECTIONS", DETECTIONS_SCHEMA, path=collection)
        records.where(delivered).orderBy(F.xxhash64("position", F.lit(run))).write.mode("append").json(f"{root}/changes")
        changes = read_changes(spark, "json", f"{root}/changes", schema=KEYED_CHANGE_SCHEMA)
        registry.watch(
            "DETECTIONS", changes, f"{root}/checkpoint", report=fine_counts, report_path=f"{root}/reports", trigger=AVAILABLE_NOW
        ).awaitTermination()
    registry.remove("DETECTIONS")
    return report_history(spark, f"{root}/reports").select((F.col("batch_id") + 1).alias("sequence"), "metric", "id", "value")
