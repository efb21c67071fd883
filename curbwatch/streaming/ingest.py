"""Device-message ingest: message stream -> JSON decode -> per-batch sink.

The pipeline is stateless (one output row per message). Unlike a bare
``foreachBatch`` append it is replay-safe:

* a checkpoint location is required, so a restart resumes from the last
  committed offsets instead of skipping what arrived while it was down;
* the sink is keyed on the streaming query's persistent id (kept in its
  checkpoint) and ``batch_id``: a path sink overwrites its
  ``query=<id>/batch_id=<n>`` folder, so a batch retried after a failure
  replaces its own output instead of appending it twice, and batches of
  another checkpoint never meet it. Whole batches are entered in the sink's
  list (``batches``), which its readers go by. A connector sink (no path) can
  keep a log in a shared folder: an entry of intent before a batch is written
  and one of commit after. A batch already written is skipped on replay; one
  with intent alone is *settled*: what the collection holds of it is read
  back, and only the rows that are missing are appended.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import STREAM_SCHEMA
from ..sources.shared_files import SharedFiles
from .batches import BatchList

CORRUPT_COLUMN = "_corrupt_record"
MESSAGE_ID_COLUMN = "message_id"
KAFKA_COORDINATES = ("topic", "partition", "offset")
MALFORMED_COLUMN = "_malformed"
MALFORMED_MODES = ("keep", "drop", "flag")


def read_messages(spark: SparkSession, format: str = "kafka", path: str | None = None, **options: str) -> DataFrame:
    """A streaming DataFrame of raw messages with a ``value`` column.

    ``format="kafka"`` needs the Kafka connector on the classpath and options
    such as ``kafka.bootstrap.servers`` and ``subscribe``; ``startingOffsets``
    defaults to ``latest`` (it applies to the first start only; later starts
    resume from the checkpoint). File formats (``text``) replay recorded
    messages from ``path``.
    """
    reader = spark.readStream.format(format)
    if format == "kafka":
        options = {"startingOffsets": "latest", **options}
    reader = reader.options(**options)
    return reader.load(path) if path is not None else reader.load()


def decode_messages(
    messages: DataFrame,
    schema: StructType = STREAM_SCHEMA,
    value_col: str = "value",
    on_malformed: str = "keep",
    message_id: bool = False,
) -> DataFrame:
    """Decode JSON payloads into the fields of ``schema`` (works on batch and
    streaming DataFrames alike).

    ``value_col`` is cast to string first (Kafka values are binary). Parsing
    is permissive: a field of the wrong type is NULL, unknown fields are
    ignored, JSON names are case sensitive, and a payload that is not a JSON
    object (or is NULL) gives a row of NULLs.

    ``on_malformed``: ``keep`` (default) keeps those rows; ``drop`` removes
    rows that failed to parse or had a field of the wrong type; ``flag``
    keeps all rows and adds ``_malformed`` (boolean) and the raw ``value``.

    ``message_id=True`` adds ``message_id`` = ``topic/partition/offset`` of
    a Kafka record: the same on every replay, so a connector sink can upsert
    on it.
    """
    if on_malformed not in MALFORMED_MODES:
        raise ValueError(f"on_malformed must be one of {MALFORMED_MODES}")
    text = F.col(value_col).cast("string")
    fields = [F.col(f"data.{f.name}").alias(f.name) for f in schema.fields]
    carried: list[Column] = []
    if message_id:
        missing = [c for c in KAFKA_COORDINATES if c not in messages.columns]
        if missing:
            raise ValueError(f"message_id needs the Kafka columns {KAFKA_COORDINATES}; missing {missing}")
        carried.append(F.concat_ws("/", *[F.col(c).cast("string") for c in KAFKA_COORDINATES]).alias(MESSAGE_ID_COLUMN))
    if on_malformed == "keep":
        return messages.select(F.from_json(text, schema).alias("data"), *carried).select(
            *fields, *[F.col(MESSAGE_ID_COLUMN)] if message_id else []
        )
    with_corrupt = StructType([*schema.fields, StructField(CORRUPT_COLUMN, StringType(), True)])
    parsed = messages.select(
        text.alias("value"),
        F.from_json(text, with_corrupt, {"columnNameOfCorruptRecord": CORRUPT_COLUMN}).alias("data"),
        *carried,
    )
    if message_id:
        fields.append(F.col(MESSAGE_ID_COLUMN))
    malformed: Column = F.col("data").isNull() | F.col(f"data.{CORRUPT_COLUMN}").isNotNull()
    if on_malformed == "drop":
        return parsed.filter(~malformed).select(*fields)
    return parsed.select(*fields, malformed.alias(MALFORMED_COLUMN), F.col("value"))


def write_collection(
    df: DataFrame,
    format: str,
    path: str | None = None,
    mode: str = "append",
    options: Mapping[str, str] | None = None,
) -> None:
    """Write ``df`` to a collection (a path, or a connector addressed by
    options such as ``database`` / ``collection``)."""
    writer = df.write.format(format).mode(mode).options(**dict(options or {}))
    if path is None:
        writer.save()
    else:
        writer.save(path)


def run_key(spark: SparkSession) -> str:
    """The persistent id of the streaming query whose batch is being handled:
    the same on every restart from one checkpoint, another one per checkpoint."""
    key = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not key:
        raise RuntimeError("only the batches of a streaming query have a query id")
    return key


class BatchSink:
    """A ``foreachBatch`` callback that writes each micro-batch once.

    With ``path``: each batch is written to ``{path}/query=<id>/batch_id=<n>``
    with overwrite, so a replayed batch replaces its earlier attempt, and then
    entered in the sink's list of batches; one that is listed is skipped.
    ``sink_rows`` reads what is listed.

    Without ``path`` (a connector addressed by ``options``, e.g.
    ``{"database": ..., "collection": ...}``) rows are appended with the
    columns ``query_id`` and ``batch_id``. With ``commit_log`` (a folder in
    shared storage) each batch is written once: the log tells of the intent
    before and of the commit after. A batch found with intent but without
    commit died in between; its rows are looked up in the collection by
    those two columns and the missing ones, counted with repeats, are
    appended. Needs a connector that can read what it wrote, but no upsert.
    """

    def __init__(
        self,
        format: str = "parquet",
        path: str | None = None,
        *,
        commit_log: str | None = None,
        options: Mapping[str, str] | None = None,
    ):
        self.format = format
        self.path = path.rstrip("/") if path else None
        self.commit_log = commit_log.rstrip("/") if commit_log else None
        self.options = dict(options or {})

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = run_key(spark)
        if self.path is not None:
            batches, folder = BatchList(spark, self.path), f"query={key}/batch_id={batch_id}"
            if not batches.committed(key, batch_id):
                write_collection(batch, self.format, f"{self.path}/{folder}", "overwrite", self.options)
                batches.commit(key, batch_id, folder)
            return
        rows = batch.withColumns({"query_id": F.lit(key), "batch_id": F.lit(batch_id)})
        if self.commit_log is None:
            self._append(rows)
            return
        files, entry = SharedFiles(spark), f"{self.commit_log}/{key}/{batch_id}"
        if files.exists(f"{entry}.commit"):
            return
        if not files.create(f"{entry}.intent", ""):
            rows = self._missing(rows, key, batch_id)
        self._append(rows)
        files.create(f"{entry}.commit", "")

    def _append(self, rows: DataFrame) -> None:
        write_collection(rows, self.format, None, "append", self.options)

    def _missing(self, rows: DataFrame, key: str, batch_id: int) -> DataFrame:
        """The rows of a batch that the collection does not hold yet."""
        reader = rows.sparkSession.read.format(self.format).options(**self.options).schema(rows.schema)
        try:
            stored = reader.load()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return rows  # nothing was ever written
        own = stored.where((F.col("query_id") == key) & (F.col("batch_id") == batch_id))
        return rows.exceptAll(own.select(rows.columns))


def sink_rows(spark: SparkSession, path: str, format: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """All rows of the listed batches of a path sink (one snapshot), without the columns that key its folders.
    ``schema`` is that of the rows; without it, it is taken from the files."""
    batches = BatchList(spark, path)
    if not batches.there():  # written before sinks kept a list
        return spark.read.format(format).load(path).drop("query", "batch_id")
    seen = batches.snapshot()
    if schema is None:
        return spark.read.format(format).load(seen.folders())
    return seen.rows(spark, schema, format)


def _quarantine_router(sink: Callable, quarantine: Callable, fields: list[str]) -> Callable:
    def route(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            sink(batch.filter(~F.col(MALFORMED_COLUMN)).select(*fields), batch_id)
            traced = ["value", *(c for c in fields if c == MESSAGE_ID_COLUMN)]
            quarantine(batch.filter(F.col(MALFORMED_COLUMN)).select(*traced), batch_id)
        finally:
            batch.unpersist()

    return route


def start_ingest(
    messages: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint_location: str,
    *,
    schema: StructType = STREAM_SCHEMA,
    value_col: str = "value",
    on_malformed: str = "keep",
    message_id: bool = False,
    quarantine: Callable[[DataFrame, int], None] | None = None,
    trigger: Mapping[str, Any] | None = None,
    output_mode: str = "append",
    query_name: str | None = None,
) -> StreamingQuery:
    """Start the ingest query: decode ``messages`` and hand each micro-batch
    to ``sink(batch_df, batch_id)``.

    ``on_malformed``: ``keep`` / ``drop`` as in ``decode_messages``, or
    ``quarantine`` to send the raw text of malformed messages (and their
    ``message_id``, if carried) to ``quarantine(batch_df, batch_id)``. ``trigger`` is passed to
    ``DataStreamWriter.trigger`` (e.g. ``{"availableNow": True}``); the
    default is Spark's (next batch as soon as the previous one ends).
    ``output_mode`` ``update`` is accepted and, with no aggregation, gives the
    same rows as ``append``. ``message_id`` carries each Kafka record's
    coordinates (see ``decode_messages``).
    """
    if not checkpoint_location:
        raise ValueError("a checkpoint location is required")
    if on_malformed == "quarantine":
        if quarantine is None:
            raise ValueError("on_malformed='quarantine' needs a quarantine sink")
        decoded = decode_messages(messages, schema, value_col, "flag", message_id)
        fields = [f.name for f in schema.fields] + ([MESSAGE_ID_COLUMN] if message_id else [])
        callback = _quarantine_router(sink, quarantine, fields)
    else:
        decoded = decode_messages(messages, schema, value_col, on_malformed, message_id)
        callback = sink
    writer = (
        decoded.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint_location)
        .foreachBatch(callback)
    )
    if trigger:
        writer = writer.trigger(**trigger)
    if query_name:
        writer = writer.queryName(query_name)
    return writer.start()
