from .config import REPORT_CONF, configure_reports, restore
from .inspect import (
    exchange_count,
    exchanges_after_partial_aggregates,
    plan_nodes,
    plan_text,
    pushed_filters,
    read_schemas,
    scan_count,
)
from .statements import Source, run_statement

__all__ = [
    "REPORT_CONF",
    "Source",
    "configure_reports",
    "exchange_count",
    "exchanges_after_partial_aggregates",
    "plan_nodes",
    "plan_text",
    "pushed_filters",
    "read_schemas",
    "restore",
    "run_statement",
    "scan_count",
]
