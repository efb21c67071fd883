from .batches import BatchList, Snapshot
from .incremental import FINE_REPORT, IncrementalReport, ReportCounts, master_report_counts
from .ingest import BatchSink, decode_messages, read_messages, sink_rows, start_ingest, write_collection
from .refresh import (
    CHANGE_SCHEMA,
    KEYED_CHANGE_SCHEMA,
    Watch,
    last_changes,
    latest_report,
    new_changes,
    read_changes,
    relevant_changes,
    report_history,
    start_refresh,
    watch_collection,
    write_report,
)

__all__ = [
    "CHANGE_SCHEMA",
    "FINE_REPORT",
    "KEYED_CHANGE_SCHEMA",
    "BatchList",
    "BatchSink",
    "IncrementalReport",
    "ReportCounts",
    "Snapshot",
    "Watch",
    "decode_messages",
    "last_changes",
    "latest_report",
    "master_report_counts",
    "new_changes",
    "read_changes",
    "read_messages",
    "relevant_changes",
    "report_history",
    "sink_rows",
    "start_ingest",
    "start_refresh",
    "watch_collection",
    "write_collection",
    "write_report",
]
