"""Master-report metrics one at a time, each one statement over one scan.

``filters`` follows ``functions.filters``. The TYPE entry is special:

* transaction count, sectors, fines per sector and manual-review count
  apply every entry, TYPE included;
* the type distribution and drops per reason ignore the TYPE entry when
  selecting rows (the type distribution uses it only to decide which kinds
  it reports, see ``emitted_kinds``).

``master_report.master_report`` computes all of them in a single scan; these
functions are for callers who need one metric. Each takes a DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from ..functions.codes import IS_DROPPED, IS_FINE, IS_MANUAL, KINDS, type_in
from ..functions.filters import emitted_kinds, filter_clause, split_type_filter
from ..plans.statements import Source, run_statement

Filters = Mapping[str, Any] | None


EMPTY_DISTRIBUTION_SQL = "SELECT CAST(NULL AS STRING) AS name, CAST(NULL AS BIGINT) AS value FROM {d} AS src WHERE FALSE"


def transaction_count(source: Source, filters: Filters = None) -> DataFrame:
    """One row: ``transactionCount``."""
    where, args = filter_clause(filters)
    return run_statement(source, f"SELECT count(1) AS transactionCount FROM {{d}} AS src WHERE {where}", args)


def sectors_count(source: Source, filters: Filters = None) -> DataFrame:
    """One row: ``sectors``, the distinct SECTOR_NAME values among fines.

    NULL and '' each count as a sector (a distinct over the column, not
    ``count(DISTINCT ...)``, which skips NULL).
    """
    where, args = filter_clause(filters)
    text = (
        "SELECT count(1) AS sectors FROM (\n"
        f"  SELECT DISTINCT SECTOR_NAME FROM {{d}} AS src WHERE {IS_FINE} AND {where})"
    )
    return run_statement(source, text, args)


def sector_fine_distribution(source: Source, filters: Filters = None) -> DataFrame:
    """Fines per sector ``(name, value)``; NULL and '' stay as they are."""
    where, args = filter_clause(filters)
    text = (
        "SELECT SECTOR_NAME AS name, count(1) AS value\n"
        f"FROM {{d}} AS src WHERE {IS_FINE} AND {where}\nGROUP BY SECTOR_NAME"
    )
    return run_statement(source, text, args)


def transaction_type_distribution(source: Source, filters: Filters = None) -> DataFrame:
    """Counts per transaction kind ``(name, value)`` in report order.

    Rows are selected by the non-TYPE entries only. A kind is reported when
    there is no filter at all, or when ``TYPE: {"$in": [...]}`` names one of
    its codes; with any other filter the result is empty (and Catalyst
    answers it without reading the table).
    """
    kinds = emitted_kinds(filters, KINDS)
    _, rest = split_type_filter(filters)
    if not kinds:
        return run_statement(source, EMPTY_DISTRIBUTION_SQL)
    where, args = filter_clause(rest)
    rows = ",\n  ".join(
        f"named_struct('name', '{name}', 'value', count_if({type_in(codes)}))"
        for name, codes in KINDS.items()
        if name in kinds
    )
    return run_statement(source, f"SELECT inline(array(\n  {rows}))\nFROM {{d}} AS src WHERE {where}", args)


def drop_reason_distribution(source: Source, filters: Filters = None) -> DataFrame:
    """Drops per reason ``(name, value)``, name being the DROP_REASON code.

    The TYPE entry is ignored (validated, not applied).
    """
    _, rest = split_type_filter(filters)
    where, args = filter_clause(rest)
    text = (
        "SELECT DROP_REASON AS name, count(1) AS value\n"
        f"FROM {{d}} AS src WHERE {IS_DROPPED} AND {where}\nGROUP BY DROP_REASON"
    )
    return run_statement(source, text, args)


def manual_review_count(source: Source, filters: Filters = None) -> DataFrame:
    """One row: ``manualReviewedTransactionCount`` (PLATE_SOURCE exactly
    'MANUAL_VALIDATION')."""
    where, args = filter_clause(filters)
    text = f"SELECT count_if({IS_MANUAL}) AS manualReviewedTransactionCount FROM {{d}} AS src WHERE {where}"
    return run_statement(source, text, args)
