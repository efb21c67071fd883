"""

Every query reads the given ``events`` table and derives the detections from
it with ``DETECTIONS_FROM_EVENTS_SQL`` (the same text is the ``detections``
CTE of every oracle), so all work grows with the table. Streaming queries
write their inputs and outputs under the session's shared checkpoint folder.
"""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Callable

# The package sits next to this file; make it importable however this file is loaded.
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, TimestampType

from curbwatch.operators import (  # noqa: E402
    drop_reason_distribution,
    fine_counts,
    fine_counts_from_rows,
    fine_document_fragments,
    fine_report_document,
    fine_report_rows,
    manual_review_count,
    master_document_fragments,
    master_report_document,
    master_report_rows,
    master_scalars,
    save_document,
    saved_document,
    section_rows,
    sector_counts,
    sector_fine_distribution,
    sectors_count,
    transaction_count,
    transaction_type_distribution,
)
from curbwatch.functions import apply_filters
from curbwatch.schema import DETECTIONS_SCHEMA
from curbwatch.session import shared_dir
from curbwatch.sources import (
    DETECTIONS_FROM_EVENTS_SQL,
    CollectionRegistry,
    full_detections_sql,
    load_detections,
    load_full_detections,
)
from curbwatch.streaming.replay import (
    collection_lookup_fresh,
    refresh_incremental,
    refresh_keyed,
    refresh_on_change,
    reports_one_snapshot,
    stream_decode,
    stream_ingest,
    stream_ingest_compacted,
    stream_ingest_settled,
    stream_ingest_two_feeds,
    stream_ingest_two_feeds_log,
)

# The corpus operators are optional: without their folder (and the pipeline file) all else works.
try:
    import corpus_pipeline
    from curbwatch.llm import queries as corpus_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "curbwatch.llm"):
        raise
    corpus_pipeline = corpus_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Filters used by the registered queries.
F_EQUALS = {"TYPE": 6}
F_IN = {"TYPE": {"$in": [1, 5]}}
F_IN_NULL = {"TYPE": {"$in": [6, None]}}
F_IN_EMPTY = {"TYPE": {"$in": []}}
F_COMBINED = {"SECTOR_NAME": "SECTOR_3", "PLATE_SOURCE": "MANUAL_VALIDATION", "TYPE": {"$in": [6, 7]}}
F_KEY_CASE = {"sector_name": "SECTOR_3"}
F_TYPE_IN_FINE = {"TYPE": {"$in": [6]}}
F_SECTOR_PAID_DROPPED = {"SECTOR_NAME": "SECTOR_3", "TYPE": {"$in": [1, 5]}}
F_SECTOR_PAID_FINE = {"SECTOR_NAME": "SECTOR_3", "TYPE": {"$in": [1, 6]}}
F_IN_AND_SOURCE = {"TYPE": {"$in": [1, 6]}, "PLATE_SOURCE": "AUTO"}
F_AUTO_TYPE_IN = {"PLATE_SOURCE": "AUTO", "TYPE": {"$in": [6]}}


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_detections(spark, sf_dir)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the fine report's counts on sf0.001."""
    return fine_counts(_detections(spark, SMOKE_DIR))


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections stored as a collection, registered with the declared schema, got by name."""
    path = shared_dir(spark, "detections_scan")
    load_full_detections(spark, sf_dir).write.parquet(path)
    registry = CollectionRegistry(spark, format="parquet")
    registry.add("parking.detections-2024", DETECTIONS_SCHEMA, path=path)
    return registry.get("parking.detections-2024")


def _with_checkpoints(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` in a session that has a checkpoint folder. A local session
    without one gets a temporary one; on a cluster the setting must be there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        unset = not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir()
        if unset and (context.master == "local" or context.master.startswith("local[")):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        return query(spark, sf_dir)

    return run


def _with(fn, filters=None) -> Callable[[SparkSession, str], DataFrame]:
    if filters is None:
        return lambda spark, sf_dir: fn(_detections(spark, sf_dir))
    return lambda spark, sf_dir: fn(_detections(spark, sf_dir), filters)


def _filtered(filters) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: apply_filters(_detections(spark, sf_dir), filters)


def _master_part(filters, section, name_type="string") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: section_rows(
        master_report_rows(_detections(spark, sf_dir), filters), section, name_type
    )


def _fine_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fine report's document written as sorted fragments, and read back whole."""
    path = shared_dir(spark, "fine_document")
    save_document(fine_document_fragments(fine_report_rows(_detections(spark, sf_dir))), path)
    return saved_document(spark, path)


def _master_saved(filters) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_dir(spark, "master_document")
        rows = master_report_rows(_detections(spark, sf_dir), filters)
        save_document(master_document_fragments(rows, filters), path)
        return saved_document(spark, path)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _with_checkpoints(query) for name, query in (_report_queries() | _corpus_queries()).items()}


def _corpus_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if corpus_queries is None:
        return {}
    return corpus_queries.queries() | {"pipeline": corpus_pipeline.run}


def _report_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # The collection scan with the declared schema
        "detections_scan": _scan,
        # Filter dictionaries
        "filter_equals": _filtered(F_EQUALS),
        "filter_in": _filtered(F_IN),
        "filter_in_null": _filtered(F_IN_NULL),
        "filter_combined": _filtered(F_COMBINED),
        "filter_key_case": _filtered(F_KEY_CASE),
        # A1, A2, F8, P5: fine report
        "fine_report_counts": _with(fine_counts),
        "fine_report_sectors": _with(sector_counts),
        "fine_report_single_scan_counts": lambda spark, sf_dir: fine_counts_from_rows(
            fine_report_rows(_detections(spark, sf_dir))
        ),
        "fine_report_single_scan_sectors": lambda spark, sf_dir: section_rows(
            fine_report_rows(_detections(spark, sf_dir)), "sectors"
        ),
        "fine_report_rows": _with(fine_report_rows),
        # Master-report metrics one at a time
        "transaction_count": _with(transaction_count),
        "transaction_count_filtered": _with(transaction_count, F_COMBINED),
        "manual_review_count": _with(manual_review_count),
        "manual_review_count_filtered": _with(manual_review_count, F_SECTOR_PAID_DROPPED),
        "sectors_count": _with(sectors_count),
        "sectors_count_filtered": _with(sectors_count, F_TYPE_IN_FINE),
        "sector_fine_distribution": _with(sector_fine_distribution),
        "sector_fine_distribution_filtered": _with(sector_fine_distribution, F_AUTO_TYPE_IN),
        "drop_reason_distribution": _with(drop_reason_distribution),
        "drop_reason_distribution_filtered": _with(drop_reason_distribution, F_AUTO_TYPE_IN),
        "transaction_type_distribution": _with(transaction_type_distribution),
        "transaction_type_distribution_type_in": _with(transaction_type_distribution, F_SECTOR_PAID_FINE),
        # Master report in one scan
        "master_report": _with(master_scalars),
        "master_report_type_in": _with(master_scalars, F_TYPE_IN_FINE),
        "master_report_sector_type_in": _with(master_scalars, F_SECTOR_PAID_DROPPED),
        "master_report_scalar_type": _with(master_scalars, F_EQUALS),
        "master_report_sector_fines": _master_part(F_TYPE_IN_FINE, "sectorsFineDistribution"),
        "master_report_type_distribution": _master_part(F_SECTOR_PAID_FINE, "transactionTypesDistribution"),
        "master_report_drop_reasons": _master_part(F_AUTO_TYPE_IN, "droppedTransactionDistribution", "int"),
        "master_report_rows": _with(master_report_rows),
        "transaction_type_distribution_in_and_source": _with(transaction_type_distribution, F_IN_AND_SOURCE),
        "master_report_empty_filter": _with(master_scalars, F_IN_EMPTY),
        "master_report_lower_type_key": _with(master_scalars, {"type": {"$in": [6]}}),
        "drop_reason_distribution_type_only": _with(drop_reason_distribution, F_TYPE_IN_FINE),
        # Report documents (exact JSON text)
        "fine_report_document": _with(fine_report_document),
        "master_report_document": _with(master_report_document),
        "master_report_document_filtered": _with(master_report_document, F_SECTOR_PAID_FINE),
        "master_report_document_empty_in": _with(master_report_document, F_IN_EMPTY),
        "master_report_document_other_filter": _with(master_report_document, {"PLATE_SOURCE": "AUTO"}),
        # Device-message decode and ingest
        "stream_decode": stream_decode,
        "stream_ingest": stream_ingest,
        "stream_ingest_two_feeds": stream_ingest_two_feeds,
        "stream_ingest_two_feeds_log": stream_ingest_two_feeds_log,
        "stream_ingest_settled": stream_ingest_settled,
        "stream_ingest_compacted": stream_ingest_compacted,
        # A lookup shows the data of its time; both reports see one snapshot of a batch sink
        "collection_lookup_fresh": collection_lookup_fresh,
        "reports_one_snapshot": reports_one_snapshot,
        # Recompute the report when the change feed says the data changed
        "refresh_on_change": refresh_on_change,
        "refresh_incremental": refresh_incremental,
        "refresh_keyed": refresh_keyed,
        # Documents of any size as sorted fragments
        "fine_report_document_saved": _fine_saved,
        "master_report_document_saved": _master_saved(None),
        "master_report_document_saved_filtered": _master_saved(F_SECTOR_PAID_FINE),
    }


# ---------------------------------------------------------------- oracle SQL

_DUCK_TYPES: dict[type, str] = {
    StringType: "VARCHAR",
    IntegerType: "INTEGER",
    LongType: "BIGINT",
    DoubleType: "DOUBLE",
    TimestampType: "TIMESTAMP",
}


def _duck_type(dt: DataType) -> str:
    if isinstance(dt, ArrayType):
        return _duck_type(dt.elementType) + "[]"
    return _DUCK_TYPES[type(dt)]


_F2_COLUMNS = {"ID", "TYPE", "PLATE_SOURCE", "SECTOR_NAME", "FINE_TYPE", "DROP_REASON", "CREATED_DATE"}

_ALL_COLUMNS = ",\n       ".join(
    f'"{f.name}"' if f.name in _F2_COLUMNS else f'CAST(NULL AS {_duck_type(f.dataType)}) AS "{f.name}"'
    for f in DETECTIONS_SCHEMA.fields
)

_FULL_COLUMNS = _F2_COLUMNS | {"CONFIDENCE_LEVEL", "DETECTION_TIME", "COORDINATES", "STATUS", "IMEI"}

_SCAN_SQL = "SELECT " + ",\n       ".join(
    f'"{f.name}"' if f.name in _FULL_COLUMNS else f'CAST(NULL AS {_duck_type(f.dataType)}) AS "{f.name}"'
    for f in DETECTIONS_SCHEMA.fields
) + f"\nFROM ({full_detections_sql('duckdb')})"

_CTE = f"WITH detections AS ({DETECTIONS_FROM_EVENTS_SQL})\n"

_FINE = "TYPE IN (6, 7)"
_MANUAL = "PLATE_SOURCE = 'MANUAL_VALIDATION'"


def _rows(where: str) -> str:
    return f"{_CTE}SELECT {_ALL_COLUMNS}\nFROM detections WHERE {where}"


def _fine_counts_sql() -> str:
    parts = [
        "SELECT 'toratalViolationCount' AS metric, 0 AS id, count(*) AS value FROM detections",
        "SELECT 'illegalParkingViolationCount', 88, count(*) FROM detections WHERE FINE_TYPE = 88",
        "SELECT 'notPaidViolationCount', 1, count(*) FROM detections WHERE FINE_TYPE = 1",
        "SELECT 'notAuthorizedViolationCount', 2, count(*) FROM detections WHERE FINE_TYPE = 2",
        "SELECT 'overStayViolationCount', 5, count(*) FROM detections WHERE FINE_TYPE = 5",
    ]
    return _CTE + "\nUNION ALL ".join(parts)


_SECTORS_SQL = (
    _CTE + "SELECT CASE WHEN SECTOR_NAME IS NULL OR SECTOR_NAME = '' THEN 'Unknown' ELSE SECTOR_NAME END AS name, "
    "count(*) AS value FROM detections GROUP BY SECTOR_NAME"
)


def _master_sql(where_all: str, where_base: str, fines: bool, dropped: bool) -> str:
    """Scalars: ``where_all`` = every filter entry, ``where_base`` = the
    entries other than TYPE; ``fines``/``dropped``: whether the type
    distribution reports that kind."""
    fines_sql = f"(SELECT count(*) FROM detections WHERE {where_base} AND {_FINE})" if fines else "CAST(0 AS BIGINT)"
    dropped_sql = f"(SELECT count(*) FROM detections WHERE {where_base} AND TYPE = 5)" if dropped else "CAST(0 AS BIGINT)"
    return (
        _CTE + f"SELECT (SELECT count(*) FROM detections WHERE {where_all}) AS transactionCount,\n"
        f"  (SELECT count(*) FROM (SELECT DISTINCT SECTOR_NAME FROM detections WHERE {where_all} AND {_FINE})) AS sectors,\n"
        f"  (SELECT count(*) FROM detections WHERE {where_all} AND {_MANUAL}) AS manualReviewedTransactionCount,\n"
        f"  {fines_sql} AS finesCount,\n"
        f"  {dropped_sql} AS droppedCount"
    )


_LABEL = "CASE WHEN SECTOR_NAME IS NULL OR SECTOR_NAME = '' THEN 'Unknown' ELSE SECTOR_NAME END"

_FINE_DOCUMENT_SQL = (
    _CTE
    + f""", per_sector AS (
  SELECT SECTOR_NAME, count(*) AS m0, count(*) FILTER (WHERE FINE_TYPE = 88) AS m1,
         count(*) FILTER (WHERE FINE_TYPE = 1) AS m2, count(*) FILTER (WHERE FINE_TYPE = 2) AS m3,
         count(*) FILTER (WHERE FINE_TYPE = 5) AS m4
  FROM detections GROUP BY SECTOR_NAME)
SELECT CAST(to_json({{'fineCounts': {{
    'toratalViolationCount': {{'value': coalesce(sum(m0), 0)::BIGINT, 'id': 0}},
    'illegalParkingViolationCount': {{'value': coalesce(sum(m1), 0)::BIGINT, 'id': 88}},
    'notPaidViolationCount': {{'value': coalesce(sum(m2), 0)::BIGINT, 'id': 1}},
    'notAuthorizedViolationCount': {{'value': coalesce(sum(m3), 0)::BIGINT, 'id': 2}},
    'overStayViolationCount': {{'value': coalesce(sum(m4), 0)::BIGINT, 'id': 5}}}},
  'sectors': coalesce(list({{'name': {_LABEL}, 'value': m0}} ORDER BY {_LABEL}, m0),
                      []::STRUCT(name VARCHAR, value BIGINT)[])}}) AS VARCHAR) AS document
FROM per_sector"""
)

_KIND_SQL = {"PaidTransaction": "TYPE = 1", "dropped": "TYPE = 5", "fine": _FINE}


def _master_document_sql(where_all: str, where_base: str, kinds: list[str]) -> str:
    """The master-report document: lists sorted like ``sort_array`` (NULL
    names first), kinds in report order."""
    kind_rows = ", ".join(
        f"{{'name': '{k}', 'value': (SELECT count(*) FROM detections WHERE {where_base} AND {_KIND_SQL[k]})}}"
        for k in kinds
    )
    kind_list = f"[{kind_rows}]" if kinds else "[]::STRUCT(name VARCHAR, value BIGINT)[]"
    fines = (
        f"(SELECT count(*) FROM detections WHERE {where_base} AND {_FINE})" if "fine" in kinds else "CAST(0 AS BIGINT)"
    )
    dropped = (
        f"(SELECT count(*) FROM detections WHERE {where_base} AND TYPE = 5)" if "dropped" in kinds else "CAST(0 AS BIGINT)"
    )
    return (
        _CTE
        + f""", fines AS (
  SELECT SECTOR_NAME AS name, count(*) AS value FROM detections WHERE {where_all} AND {_FINE} GROUP BY SECTOR_NAME),
drops AS (
  SELECT DROP_REASON AS name, count(*) AS value FROM detections WHERE {where_base} AND TYPE = 5 GROUP BY DROP_REASON)
SELECT CAST(to_json({{
  'transactionCount': (SELECT count(*) FROM detections WHERE {where_all}),
  'sectors': (SELECT count(*) FROM fines),
  'sectorsFineDistribution': (SELECT coalesce(list({{'name': name, 'value': value}} ORDER BY name NULLS FIRST, value),
                                              []::STRUCT(name VARCHAR, value BIGINT)[]) FROM fines),
  'transactionTypesDistribution': {kind_list},
  'droppedTransactionDistribution': (SELECT coalesce(list({{'name': name, 'value': value}} ORDER BY name NULLS FIRST, value),
                                                     []::STRUCT(name INTEGER, value BIGINT)[]) FROM drops),
  'manualReviewedTransactionCount': (SELECT count(*) FROM detections WHERE {where_all} AND {_MANUAL}),
  'finesCount': {fines},
  'droppedCount': {dropped}}}) AS VARCHAR) AS document"""
    )

_PAYLOAD_SQL = """
SELECT CASE WHEN event_type = 'view' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS imei,
       CASE WHEN event_type = 'view' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS "time",
       CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE CAST(event_id % 10 AS INTEGER) END AS status,
       CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS assetId,
       CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS crewId,
       CASE WHEN event_type = 'view' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS "timestamp"
FROM events
"""


def _refresh_sql() -> str:
    """The report after each of the four relevant runs, over the parts stored so far."""
    counted = _fine_counts_sql().removeprefix(_CTE)
    runs = []
    for run in range(1, 5):
        part = f"(SELECT * FROM detections WHERE CAST(ID AS BIGINT) % 5 < {run})"
        runs.append(f"SELECT CAST({run} AS INTEGER) AS sequence, * FROM ({counted.replace('FROM detections', f'FROM {part}')})")
    return _CTE + "\nUNION ALL ".join(runs)


def _lookup_sql() -> str:
    """The counts before and after the odd detections are there."""
    counted = _fine_counts_sql().removeprefix(_CTE)
    even = counted.replace("FROM detections", "FROM (SELECT * FROM detections WHERE CAST(ID AS BIGINT) % 2 = 0)")
    return _CTE + f"SELECT 1 AS step, * FROM ({even})\nUNION ALL SELECT 2, * FROM ({counted})"


def _snapshot_sql() -> str:
    """Both reports over the even detections, and over all."""
    parts = []
    for step, where in ((1, "CAST(ID AS BIGINT) % 2 = 0"), (2, "true")):
        for report, rows in (("fine", _fine_rows_sql()), ("master", _master_rows_sql())):
            rows = rows.removeprefix(_CTE).replace("FROM detections", f"FROM (SELECT * FROM detections WHERE {where})")
            parts.append(f"SELECT {step} AS step, '{report}' AS report, * FROM ({rows})")
    return _CTE + "\nUNION ALL ".join(parts)


def _incremental_sql() -> str:
    """The fine report after each change of the parts (by ID % 4)."""
    rows = _fine_rows_sql().removeprefix(_CTE)
    part = "SELECT SECTOR_NAME, FINE_TYPE FROM detections WHERE CAST(ID AS BIGINT) % 4 = "
    updated = "SELECT SECTOR_NAME, 88 AS FINE_TYPE FROM detections WHERE CAST(ID AS BIGINT) % 4 = 1"
    after = [(part + "0", part + "1"), (part + "0", updated), (part + "2", updated), (part + "2",), (part + "2", part + "3")]
    runs = []
    for i, parts in enumerate(after):
        table = f"FROM ({' UNION ALL '.join(parts)})"
        runs.append(f"SELECT CAST({i + 1} AS INTEGER) AS sequence, * FROM ({rows.replace('FROM detections', table)})")
    return _CTE + "\nUNION ALL ".join(runs)


def _keyed_sql() -> str:
    counted = _fine_counts_sql().removeprefix(_CTE)
    first = counted.replace("FROM detections", "FROM (SELECT * FROM detections WHERE CAST(ID AS BIGINT) % 3 = 0)")
    return _CTE + f"SELECT CAST(1 AS INTEGER) AS sequence, * FROM ({first})\nUNION ALL SELECT CAST(3 AS INTEGER), * FROM ({counted})"


def _fine_rows_sql() -> str:
    counts, sectors = (x.removeprefix(_CTE) for x in (_fine_counts_sql(), _SECTORS_SQL))
    return (
        _CTE + f"SELECT 'fineCounts' AS section, metric AS name, value FROM ({counts})\n"
        f"UNION ALL SELECT 'sectors', name, value FROM ({sectors})"
    )


def _master_rows_sql() -> str:
    scalars = {
        "transactionCount": "count(*)",
        "sectors": f"(SELECT count(*) FROM (SELECT DISTINCT SECTOR_NAME FROM detections WHERE {_FINE}))",
        "manualReviewedTransactionCount": f"count(*) FILTER (WHERE {_MANUAL})",
        "finesCount": f"count(*) FILTER (WHERE {_FINE})",
        "droppedCount": "count(*) FILTER (WHERE TYPE = 5)",
    }
    parts = [
        f"SELECT '{k}' AS section, CAST(NULL AS VARCHAR) AS name, (SELECT {v} FROM detections LIMIT 1) AS value"
        for k, v in scalars.items()
    ]
    parts += [
        f"SELECT 'transactionTypesDistribution', '{k}', count(*) FILTER (WHERE {w}) FROM detections" for k, w in _KIND_SQL.items()
    ]
    parts.append(f"SELECT 'sectorsFineDistribution', SECTOR_NAME, count(*) FROM detections WHERE {_FINE} GROUP BY SECTOR_NAME")
    parts.append(
        "SELECT 'droppedTransactionDistribution', CAST(DROP_REASON AS VARCHAR), count(*) "
        "FROM detections WHERE TYPE = 5 GROUP BY DROP_REASON"
    )
    return _CTE + "\nUNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    if corpus_queries is None:
        return _report_sql()
    pipeline_sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return _report_sql() | corpus_queries.oracle_sql() | pipeline_sql


def _report_sql() -> dict[str, str]:
    sector3 = "SECTOR_NAME = 'SECTOR_3'"
    return {
        "detections_scan": _SCAN_SQL,
        "filter_equals": _rows("TYPE = 6"),
        "filter_in": _rows("TYPE IN (1, 5)"),
        "filter_in_null": _rows("TYPE IN (6, NULL)"),
        "filter_combined": _rows(f"{sector3} AND {_MANUAL} AND {_FINE}"),
        "filter_key_case": _rows(sector3),
        "fine_report_counts": _fine_counts_sql(),
        "fine_report_sectors": _SECTORS_SQL,
        "fine_report_single_scan_counts": _fine_counts_sql(),
        "fine_report_single_scan_sectors": _SECTORS_SQL,
        "transaction_count": _CTE + "SELECT count(*) AS transactionCount FROM detections",
        "transaction_count_filtered": _CTE
        + f"SELECT count(*) AS transactionCount FROM detections WHERE {sector3} AND {_MANUAL} AND {_FINE}",
        "manual_review_count": _CTE
        + f"SELECT count(*) FILTER (WHERE {_MANUAL}) AS manualReviewedTransactionCount FROM detections",
        "manual_review_count_filtered": _CTE
        + f"SELECT count(*) FILTER (WHERE {_MANUAL}) AS manualReviewedTransactionCount FROM detections "
        f"WHERE {sector3} AND TYPE IN (1, 5)",
        "sectors_count": _CTE + f"SELECT count(*) AS sectors FROM (SELECT DISTINCT SECTOR_NAME FROM detections WHERE {_FINE})",
        "sectors_count_filtered": _CTE
        + f"SELECT count(*) AS sectors FROM (SELECT DISTINCT SECTOR_NAME FROM detections WHERE {_FINE} AND TYPE IN (6))",
        "sector_fine_distribution": _CTE
        + f"SELECT SECTOR_NAME AS name, count(*) AS value FROM detections WHERE {_FINE} GROUP BY SECTOR_NAME",
        "sector_fine_distribution_filtered": _CTE
        + f"SELECT SECTOR_NAME AS name, count(*) AS value FROM detections "
        f"WHERE {_FINE} AND PLATE_SOURCE = 'AUTO' AND TYPE IN (6) GROUP BY SECTOR_NAME",
        "drop_reason_distribution": _CTE
        + "SELECT DROP_REASON AS name, count(*) AS value FROM detections WHERE TYPE = 5 GROUP BY DROP_REASON",
        "drop_reason_distribution_filtered": _CTE
        + "SELECT DROP_REASON AS name, count(*) AS value FROM detections "
        "WHERE TYPE = 5 AND PLATE_SOURCE = 'AUTO' GROUP BY DROP_REASON",
        "transaction_type_distribution": _CTE
        + "SELECT 'PaidTransaction' AS name, count(*) AS value FROM detections WHERE TYPE = 1\n"
        "UNION ALL SELECT 'dropped', count(*) FROM detections WHERE TYPE = 5\n"
        f"UNION ALL SELECT 'fine', count(*) FROM detections WHERE {_FINE}",
        "transaction_type_distribution_type_in": _CTE
        + f"SELECT 'PaidTransaction' AS name, count(*) AS value FROM detections WHERE {sector3} AND TYPE = 1\n"
        f"UNION ALL SELECT 'fine', count(*) FROM detections WHERE {sector3} AND {_FINE}",
        "master_report": _master_sql("true", "true", True, True),
        "master_report_type_in": _master_sql("TYPE IN (6)", "true", True, False),
        "master_report_sector_type_in": _master_sql(f"{sector3} AND TYPE IN (1, 5)", sector3, False, True),
        "master_report_scalar_type": _master_sql("TYPE = 6", "true", False, False),
        "master_report_sector_fines": _CTE
        + f"SELECT SECTOR_NAME AS name, count(*) AS value FROM detections WHERE {_FINE} AND TYPE IN (6) GROUP BY SECTOR_NAME",
        "master_report_type_distribution": _CTE
        + f"SELECT 'PaidTransaction' AS name, count(*) AS value FROM detections WHERE {sector3} AND TYPE = 1\n"
        f"UNION ALL SELECT 'fine', count(*) FROM detections WHERE {sector3} AND {_FINE}",
        "master_report_drop_reasons": _CTE
        + "SELECT DROP_REASON AS name, count(*) AS value FROM detections "
        "WHERE TYPE = 5 AND PLATE_SOURCE = 'AUTO' GROUP BY DROP_REASON",
        "master_report_empty_filter": _master_sql("false", "true", False, False),
        # only the exact key TYPE is special: "type" filters every metric like any column
        "master_report_lower_type_key": _master_sql("TYPE IN (6)", "TYPE IN (6)", False, False),
        # drops per reason ignore the TYPE entry
        "drop_reason_distribution_type_only": _CTE
        + "SELECT DROP_REASON AS name, count(*) AS value FROM detections WHERE TYPE = 5 GROUP BY DROP_REASON",
        "fine_report_document": _FINE_DOCUMENT_SQL,
        "master_report_document": _master_document_sql("true", "true", ["PaidTransaction", "dropped", "fine"]),
        "master_report_document_filtered": _master_document_sql(
            f"{sector3} AND TYPE IN (1, 6)", sector3, ["PaidTransaction", "fine"]
        ),
        "master_report_document_other_filter": _master_document_sql("PLATE_SOURCE = 'AUTO'", "PLATE_SOURCE = 'AUTO'", []),
        "stream_decode": _PAYLOAD_SQL,
        "stream_ingest": _PAYLOAD_SQL,
        "stream_ingest_two_feeds": _PAYLOAD_SQL,
        "stream_ingest_two_feeds_log": _PAYLOAD_SQL,
        "stream_ingest_settled": _PAYLOAD_SQL,
        "stream_ingest_compacted": _PAYLOAD_SQL,
        "collection_lookup_fresh": _lookup_sql(),
        "reports_one_snapshot": _snapshot_sql(),
        "refresh_on_change": _refresh_sql(),
        "refresh_incremental": _incremental_sql(),
        "refresh_keyed": _keyed_sql(),
        "fine_report_document_saved": _FINE_DOCUMENT_SQL,
        "master_report_document_saved": _master_document_sql("true", "true", ["PaidTransaction", "dropped", "fine"]),
        "master_report_document_saved_filtered": _master_document_sql(
            f"{sector3} AND TYPE IN (1, 6)", sector3, ["PaidTransaction", "fine"]
        ),
        "fine_report_rows": _fine_rows_sql(),
        "master_report_rows": _master_rows_sql(),
        "transaction_type_distribution_in_and_source": _CTE
        + "SELECT 'PaidTransaction' AS name, count(*) AS value FROM detections WHERE PLATE_SOURCE = 'AUTO' AND TYPE = 1\n"
        f"UNION ALL SELECT 'fine', count(*) FROM detections WHERE PLATE_SOURCE = 'AUTO' AND {_FINE}",
        "master_report_document_empty_in": _master_document_sql("false", "true", []),
    }
