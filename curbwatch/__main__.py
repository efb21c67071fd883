"""Job entry points (``python -m curbwatch`` or ``spark-submit``).

``ingest``: run the device-message ingest until stopped (or once over what is
available with ``--available-now``).

``report fine|master``: register the detections collection with the declared
schema, compute one report and print its JSON document, or write its rows with
``--output-path``. Runs under ``plans.REPORT_CONF``.

``watch fine|master``: register the collection and follow its change feed: every
relevant change re-reads the collection (with ``--state-path`` only the files
that changed) and publishes the report's rows (``streaming.latest_report`` reads them).

The session comes from ``SparkSession.builder.getOrCreate()``, so master,
connector packages and credentials are whatever spark-submit / spark-defaults
provide; nothing is hard-coded here.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans import configure_reports, restore


def _options(pairs: list[str]) -> dict[str, str]:
    options = {}
    for pair in pairs:
        key, sep, value = pair.partition("=")
        if not sep:
            raise SystemExit(f"--option needs key=value, got {pair!r}")
        options[key] = value
    return options


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="curbwatch")
    sub = parser.add_subparsers(dest="command", required=True)

    ingest = sub.add_parser("ingest", help="stream device messages into a collection")
    ingest.add_argument("--source-format", default="kafka")
    ingest.add_argument("--source-path")
    ingest.add_argument("--source-option", action="append", default=[], metavar="KEY=VALUE")
    ingest.add_argument("--sink-format", default="parquet")
    ingest.add_argument("--sink-path")
    ingest.add_argument("--sink-option", action="append", default=[], metavar="KEY=VALUE")
    ingest.add_argument("--commit-log", help="shared folder for the batch commit log of a connector sink")
    ingest.add_argument("--checkpoint", required=True)
    ingest.add_argument("--message-id", action="store_true", help="carry each Kafka record's coordinates, to upsert on")
    ingest.add_argument("--on-malformed", default="keep", choices=["keep", "drop", "quarantine"])
    ingest.add_argument("--quarantine-format", default="json")
    ingest.add_argument("--quarantine-path", help="where malformed messages go with --on-malformed quarantine")
    ingest.add_argument("--available-now", action="store_true")

    report = sub.add_parser("report", help="print a report document, or write its rows")
    report.add_argument("--output-path", help="write the report as rows there instead of printing the document")
    watch = sub.add_parser("watch", help="write a report's rows anew whenever the change feed tells of a change")
    watch.add_argument("--changes-format", default="json")
    watch.add_argument("--changes-path")
    watch.add_argument("--changes-option", action="append", default=[], metavar="KEY=VALUE")
    watch.add_argument("--report-path", required=True)
    watch.add_argument("--state-path", help="keep the report from the files that change; its counts per file go there")
    watch.add_argument("--checkpoint", required=True)
    watch.add_argument("--available-now", action="store_true")
    for command in (report, watch):
        command.add_argument("kind", choices=["fine", "master"])
        command.add_argument("--format", default="parquet")
        command.add_argument("--path")
        command.add_argument("--option", action="append", default=[], metavar="KEY=VALUE")
        command.add_argument("--collection", default="DETECTIONS")
        command.add_argument("--filter", default=None, help="master report filter as JSON")
    return parser


def _ingest(args: argparse.Namespace, spark: SparkSession) -> None:
    from .streaming import BatchSink, read_messages, start_ingest

    quarantine = None
    if args.on_malformed == "quarantine":
        if not args.quarantine_path:
            raise SystemExit("--on-malformed quarantine needs --quarantine-path")
        quarantine = BatchSink(args.quarantine_format, args.quarantine_path)
    messages = read_messages(spark, args.source_format, args.source_path, **_options(args.source_option))
    sink = BatchSink(args.sink_format, args.sink_path, commit_log=args.commit_log, options=_options(args.sink_option))
    query = start_ingest(
        messages,
        sink,
        args.checkpoint,
        on_malformed=args.on_malformed,
        message_id=args.message_id,
        quarantine=quarantine,
        trigger={"availableNow": True} if args.available_now else None,
    )
    query.awaitTermination()


def _report_or_watch(args: argparse.Namespace, spark: SparkSession) -> None:
    from .operators import fine_report_document, fine_report_rows, master_report_document, master_report_rows
    from .schema import DETECTIONS_SCHEMA
    from .sources import CollectionRegistry

    registry = CollectionRegistry(spark, format=args.format, **_options(args.option))
    collection = registry.add(args.collection, DETECTIONS_SCHEMA, path=args.path)
    filters = json.loads(args.filter) if args.filter else None

    def rows(df: DataFrame) -> DataFrame:
        return fine_report_rows(df) if args.kind == "fine" else master_report_rows(df, filters)

    if args.command == "watch":
        from .streaming import FINE_REPORT, IncrementalReport, master_report_counts, read_changes

        incremental = None
        if args.state_path:
            counts = FINE_REPORT if args.kind == "fine" else master_report_counts(filters)
            incremental = IncrementalReport(
                spark, lambda: registry.roots(args.collection), DETECTIONS_SCHEMA, args.state_path, counts, args.format
            )
        changes = read_changes(spark, args.changes_format, args.changes_path, **_options(args.changes_option))
        query = registry.watch(
            args.collection,
            changes,
            args.checkpoint,
            report=None if incremental else rows,
            incremental=incremental,
            report_path=args.report_path,
            trigger={"availableNow": True} if args.available_now else None,
        )
        query.awaitTermination()
    elif args.output_path:
        rows(collection).write.mode("overwrite").parquet(args.output_path)
    else:
        document = fine_report_document(collection) if args.kind == "fine" else master_report_document(collection, filters)
        print(document.first()["document"])
    registry.remove(args.collection)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "ingest":
        _ingest(args, spark)
        return 0
    previous = configure_reports(spark)
    try:
        _report_or_watch(args, spark)
    finally:
        restore(spark, previous)
    return 0


if __name__ == "__main__":
    sys.exit(main())
