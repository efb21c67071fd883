"""Master report in a single scan.

Every metric of ``operators.metrics`` comes out of one pass over the table,
as one SQL statement:

1. Rows are selected by the non-TYPE filter entries ``b`` (pushed to the
   scan). The TYPE entry ``t`` moves inside conditional counts, since the
   type distribution and drops per reason ignore it; what reaches the scan is
   ``t OR TYPE IN (1, 5, 6, 7)``, exact because a row outside both feeds no
   metric.
2. Each row gets a *role*: 1 = a fine that passes ``t`` (it feeds fines per
   sector), 2 = a dropped row (it feeds drops per reason), 0 = neither. The
   two are exclusive (TYPE 6/7 vs 5). The scan is aggregated on
   ``(role, SECTOR_NAME if role 1, DROP_REASON if role 2)`` with every
   conditional count. That result has at most 1 + #sectors + #reasons rows,
   whatever the data size (no sector x reason product), and counts are
   combined map-side first, so one hot sector costs one partial row per task.
3. A global aggregate over that small result gives the report row: scalar
   sums, the role-1 groups as fines per sector, the role-2 groups as drops
   per reason, and the type distribution from sums.

The global aggregate always yields one row, so empty input gives an all-zero
report with empty distributions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.codes import IS_COUNTED_KIND, IS_DROPPED, IS_FINE, IS_MANUAL, KINDS, type_in
from ..functions.filters import emitted_kinds, filter_clause, split_type_filter
from ..plans.statements import Source, run_statement
from ..schema import KIND_DROPPED, KIND_FINE
from .metrics import Filters

ROLE_OTHER, ROLE_SECTOR_FINE, ROLE_DROP = 0, 1, 2

SCALARS = ("transactionCount", "sectors", "manualReviewedTransactionCount", "finesCount", "droppedCount")

DISTRIBUTIONS = ("sectorsFineDistribution", "transactionTypesDistribution", "droppedTransactionDistribution")

# --- Fixed values: keys of the report document, in order.
DOCUMENT_KEYS = (
    "transactionCount",
    "sectors",
    "sectorsFineDistribution",
    "transactionTypesDistribution",
    "droppedTransactionDistribution",
    "manualReviewedTransactionCount",
    "finesCount",
    "droppedCount",
)

_KIND_COUNTS = ", ".join(f"count_if({type_in(codes)}) AS k{i}" for i, codes in enumerate(KINDS.values()))

# One projection level: role 1 = fine passing t, role 2 = dropped (TYPE 5
# can never be a fine, so "dropped" alone decides role 2 and its reason key).
PARTIALS_SQL = f"""SELECT {{by}}role, sector, reason,
       count(1) AS n,
       count_if(in_type) AS n_txn,
       count_if(in_type AND {IS_MANUAL}) AS n_manual,
       {_KIND_COUNTS}
FROM (
  SELECT {{by}}CASE WHEN ({{type_where}}) AND {IS_FINE} THEN {ROLE_SECTOR_FINE}
              WHEN {IS_DROPPED} THEN {ROLE_DROP} ELSE {ROLE_OTHER} END AS role,
         CASE WHEN ({{type_where}}) AND {IS_FINE} THEN SECTOR_NAME END AS sector,
         CASE WHEN {IS_DROPPED} THEN DROP_REASON END AS reason,
         ({{type_where}}) AS in_type, TYPE, PLATE_SOURCE
  FROM {{{{d}}}} AS src WHERE {{base_where}} AND {{relevant}})
GROUP BY {{by}}role, sector, reason"""

# the same groups of counts that were made of parts of a table
_SUMS_SQL = (
    "SELECT role, sector, reason, "
    + ", ".join(f"sum({c}) AS {c}" for c in ("n", "n_txn", "n_manual", *(f"k{i}" for i in range(len(KINDS)))))
    + " FROM {d} GROUP BY role, sector, reason"
)

_TYPE_DIST_TYPE = "ARRAY<STRUCT<name: STRING, value: BIGINT>>"


def _partials_sql(filters: Filters, by: list[str] | None = None) -> tuple[str, dict]:
    type_entry, rest = split_type_filter(filters)
    base_where, base_args = filter_clause(rest, "b")
    type_where, type_args = filter_clause(type_entry, "t")
    relevant = "TRUE" if type_entry is None else f"(({type_where}) OR {IS_COUNTED_KIND})"
    keys = "".join(f"{name}, " for name in by or ())
    text = PARTIALS_SQL.format(base_where=base_where, type_where=type_where, relevant=relevant, by=keys)
    return text, {**base_args, **type_args}


def master_partials(source: Source, filters: Filters = None) -> DataFrame:
    """Step 1-2: the small per-role pre-aggregate of the (filtered) scan.

    Columns: role, sector, reason, n (rows in the group), n_txn, n_manual and
    one k<i> per transaction kind.
    """
    text, args = _partials_sql(filters)
    return run_statement(source, text, args)


def report_sql(filters: Filters) -> tuple[str, dict]:
    """Statement text and parameters of the master report row."""
    kinds = emitted_kinds(filters, KINDS)
    partials, args = _partials_sql(filters)
    totals = {name: f"coalesce(sum(k{i}), 0)" for i, name in enumerate(KINDS)}
    type_rows = [f"named_struct('name', '{name}', 'value', {totals[name]})" for name in KINDS if name in kinds]
    type_dist = f"array({', '.join(type_rows)})" if type_rows else f"CAST(array() AS {_TYPE_DIST_TYPE})"
    fines = totals[KIND_FINE] if KIND_FINE in kinds else "CAST(0 AS BIGINT)"
    dropped = totals[KIND_DROPPED] if KIND_DROPPED in kinds else "CAST(0 AS BIGINT)"
    text = f"""WITH partials AS (
{partials})
SELECT coalesce(sum(n_txn), 0) AS transactionCount,
       count_if(role = {ROLE_SECTOR_FINE}) AS sectors,
       collect_list(CASE WHEN role = {ROLE_SECTOR_FINE} THEN named_struct('name', sector, 'value', n) END)
         AS sectorsFineDistribution,
       {type_dist} AS transactionTypesDistribution,
       collect_list(CASE WHEN role = {ROLE_DROP} THEN named_struct('name', reason, 'value', n) END)
         AS droppedTransactionDistribution,
       coalesce(sum(n_manual), 0) AS manualReviewedTransactionCount,
       {fines} AS finesCount,
       {dropped} AS droppedCount
FROM partials"""
    return text, args


def report_rows_sql(filters: Filters, counted: bool = False) -> tuple[str, dict]:
    """Statement text and parameters of the master report as rows, over the table or (``counted``) over
    counts of its parts."""
    kinds = emitted_kinds(filters, KINDS)
    partials, args = (_SUMS_SQL, {}) if counted else _partials_sql(filters)
    counts = {name: f"k{i}" for i, name in enumerate(KINDS)}
    scalars = {
        "transactionCount": "n_txn",
        "sectors": f"CAST(role = {ROLE_SECTOR_FINE} AS BIGINT)",
        "manualReviewedTransactionCount": "n_manual",
        "finesCount": counts[KIND_FINE] if KIND_FINE in kinds else "0L",
        "droppedCount": counts[KIND_DROPPED] if KIND_DROPPED in kinds else "0L",
    }

    def row(section: str, name: str, value: str) -> str:
        return f"named_struct('section', '{section}', 'name', {name}, 'value', {value})"

    fixed = [(key, "CAST(NULL AS STRING)", value) for key, value in scalars.items()]
    fixed += [("transactionTypesDistribution", f"'{name}'", counts[name]) for name in KINDS if name in kinds]
    lists = [
        f"IF(role = {ROLE_SECTOR_FINE}, array({row('sectorsFineDistribution', 'sector', 'n')}), array())",
        f"IF(role = {ROLE_DROP}, array({row('droppedTransactionDistribution', 'CAST(reason AS STRING)', 'n')}), array())",
    ]
    text = f"""WITH partials AS (
{partials}),
parts AS (
  SELECT inline(concat(array({', '.join(row(*f) for f in fixed)}), {', '.join(lists)})) FROM partials
  UNION ALL SELECT inline(array({', '.join(row(s, n, '0L') for s, n, _ in fixed)})))
SELECT section, name, sum(value) AS value FROM parts GROUP BY section, name"""
    return text, args


def master_report_rows(source: Source, filters: Filters = None) -> DataFrame:
    """The whole master report as rows ``(section, name, value)``, from one scan.

    A scalar is a section with one row (name NULL); a distribution is a
    section with a row per sector, kind or reason (as a string). Straight from
    the pre-aggregate: any number of sectors or reasons stays spread.
    """
    text, args = report_rows_sql(filters)
    return run_statement(source, text, args)


def master_counts_by(source: Source, by: list[str], filters: Filters = None) -> DataFrame:
    """``master_partials`` per the columns ``by`` as well: what ``master_rows_from`` adds up."""
    text, args = _partials_sql(filters, by)
    return run_statement(source, text, args)


def master_rows_from(counts: DataFrame, filters: Filters = None) -> DataFrame:
    """``master_report_rows`` from ``master_counts_by`` with the same filters."""
    text, args = report_rows_sql(filters, counted=True)
    return run_statement(counts, text, args)


def master_report(source: Source, filters: Filters = None) -> DataFrame:
    """The whole master report as one row, from one scan. The row holds every
    sector and reason in lists, since that row is the document; for tables use
    ``master_report_rows``.

    Scalars (bigint): transactionCount, sectors, manualReviewedTransactionCount,
    finesCount, droppedCount. Distributions: sectorsFineDistribution
    ``array<struct<name: string, value: bigint>>``,
    transactionTypesDistribution (same type, report order),
    droppedTransactionDistribution ``array<struct<name: int, value: bigint>>``.
    Distribution order inside the arrays is unspecified.
    """
    text, args = report_sql(filters)
    return run_statement(source, text, args)


def master_scalars(source: Source, filters: Filters = None) -> DataFrame:
    """The five scalar metrics of ``master_report`` (one row)."""
    text, args = report_sql(filters)
    return run_statement(source, f"SELECT {', '.join(SCALARS)} FROM (\n{text})", args)


def explode_distribution(report: DataFrame, name: str) -> DataFrame:
    """Rows ``(name, value)`` of one distribution column of a report row."""
    return report.selectExpr(f"inline({name})")


def section_rows(rows: DataFrame, section: str, name_type: str = "string") -> DataFrame:
    """Rows ``(name, value)`` of one section of ``master_report_rows`` or ``fine_report_rows``."""
    return rows.where(rows["section"] == section).selectExpr(f"CAST(name AS {name_type}) AS name", "value")
