"""Fine report: violation counts by fine code, and rows per sector.

The report takes no filter: request parameters are validated by
``functions.fine_report_params`` and then not applied (callers who want a
subset compose ``apply_filters`` first). The total is over all rows; the
code counts look at FINE_TYPE alone, so they need not add up to the total.

Every function takes a DataFrame and returns one built from one SQL statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.codes import SECTOR_LABEL, has_fine_code
from ..plans.statements import Source, run_statement
from ..schema import FINE_METRICS


def _count(code: int) -> str:
    """The count behind one metric: all rows for id 0, else one fine code."""
    return "count(1)" if code == 0 else f"count_if({has_fine_code(code)})"


def _metric_rows(values: list[str]) -> str:
    """``inline`` of one (metric, id, value) struct per metric."""
    rows = ",\n  ".join(
        f"named_struct('metric', '{key}', 'id', {code}, 'value', {value})"
        for (key, code), value in zip(FINE_METRICS, values)
    )
    return f"inline(array(\n  {rows}))"


FINE_COUNTS_SQL = "SELECT " + _metric_rows([_count(code) for _, code in FINE_METRICS]) + "\nFROM {d}"

SECTOR_COUNTS_SQL = f"SELECT {SECTOR_LABEL} AS name, count(1) AS value\nFROM {{d}}\nGROUP BY SECTOR_NAME"

_metric_structs = ",\n       ".join(
    f"named_struct('value', coalesce(sum(m{i}), 0), 'id', {code}) AS {key}"
    for i, (key, code) in enumerate(FINE_METRICS)
)
FINE_REPORT_SQL = f"""WITH per_sector AS (
  SELECT SECTOR_NAME, {', '.join(f"{_count(code)} AS m{i}" for i, (_, code) in enumerate(FINE_METRICS))}
  FROM {{d}}
  GROUP BY SECTOR_NAME)
SELECT {_metric_structs},
       collect_list(named_struct('name', {SECTOR_LABEL}, 'value', m0)) AS sectors
FROM per_sector"""


# Rows straight from the pre-aggregate: no list, no single task. The zero rows
# keep every metric there on empty input.
_partial_rows = ", ".join(
    f"named_struct('section', 'fineCounts', 'raw', '{key}', 'name', '{key}', 'value', m{i})"
    for i, (key, _) in enumerate(FINE_METRICS)
)
_zero_rows = ", ".join(
    f"named_struct('section', 'fineCounts', 'raw', '{key}', 'name', '{key}', 'value', 0L)" for key, _ in FINE_METRICS
)
_COUNTS = ", ".join(f"{_count(code)} AS m{i}" for i, (_, code) in enumerate(FINE_METRICS))
_SUMS = ", ".join(f"sum(m{i}) AS m{i}" for i in range(len(FINE_METRICS)))


def _rows_sql(counts: str) -> str:
    """The report's rows; ``counts`` are the counts per raw sector."""
    return f"""WITH per_sector AS (
  SELECT SECTOR_NAME, {counts}
  FROM {{d}}
  GROUP BY SECTOR_NAME),
parts AS (
  SELECT inline(array({_partial_rows},
    named_struct('section', 'sectors', 'raw', SECTOR_NAME, 'name', {SECTOR_LABEL}, 'value', m0))) FROM per_sector
  UNION ALL SELECT inline(array({_zero_rows})))
SELECT section, name, sum(value) AS value FROM parts GROUP BY section, raw, name"""


FINE_ROWS_SQL = _rows_sql(_COUNTS)


def fine_counts(source: Source) -> DataFrame:
    """Five rows ``(metric, id, value)``: total (id 0) and one per fine code.

    One global aggregate over the scan (partial counts per task, one tiny
    exchange); five zero rows on empty input.
    """
    return run_statement(source, FINE_COUNTS_SQL)


def sector_counts(source: Source) -> DataFrame:
    """Rows per sector ``(name, value)``, over all rows.

    Grouped on the raw SECTOR_NAME, then labelled: NULL, '' and a literal
    'Unknown' are separate rows that all read 'Unknown'. Counts are combined
    map-side, so a sector holding most rows costs one partial row per task.
    """
    return run_statement(source, SECTOR_COUNTS_SQL)


def fine_report_rows(source: Source) -> DataFrame:
    """The whole fine report as rows ``(section, name, value)``, from one scan:
    section ``fineCounts`` with a row per metric, ``sectors`` with a row per
    raw sector (labelled as in ``sector_counts``). Any number of sectors
    stays spread over the shuffle partitions."""
    return run_statement(source, FINE_ROWS_SQL)


def fine_counts_by(source: Source, by: list[str]) -> DataFrame:
    """The counts behind the fine report per raw sector and the columns ``by``: what ``fine_rows_from``
    adds up, so counts of parts of a table make the report of the whole."""
    keys = "".join(f"{name}, " for name in by)
    return run_statement(source, f"SELECT {keys}SECTOR_NAME, {_COUNTS} FROM {{d}} GROUP BY {keys}SECTOR_NAME")


def fine_rows_from(counts: DataFrame) -> DataFrame:
    """``fine_report_rows`` from ``fine_counts_by``."""
    return run_statement(counts, _rows_sql(_SUMS))


def fine_report(source: Source) -> DataFrame:
    """The whole fine report as one row, from one scan. The row holds every
    sector in a list, since that row is the document; for tables use
    ``fine_report_rows``.

    Columns: one ``struct<value: bigint, id: int>`` per metric (document keys
    as column names) and ``sectors: array<struct<name, value>>``.
    The scan is pre-aggregated per raw sector with all code counts; the row is
    then a global aggregate over that small result (one row per sector).
    """
    return run_statement(source, FINE_REPORT_SQL)


def fine_counts_from_report(report: DataFrame) -> DataFrame:
    """The five ``(metric, id, value)`` rows of a ``fine_report`` row."""
    return report.selectExpr(_metric_rows([f"{key}.value" for key, _ in FINE_METRICS]))


def fine_counts_from_rows(report: DataFrame) -> DataFrame:
    """The five ``(metric, id, value)`` rows of a ``fine_report_rows`` result."""
    ids = " ".join(f"WHEN '{key}' THEN {code}" for key, code in FINE_METRICS)
    rows = report.where("section = 'fineCounts'")
    return rows.selectExpr("name AS metric", f"CASE name {ids} END AS id", "value")
