"""Detections as DataFrames: conform any source to the declared schema, and
derive a detections table from the ``events`` table for tests and benches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.filters import quote_identifier
from ..schema import DETECTIONS_SCHEMA

# Detections derived from ``events``: one text that Spark and DuckDB both
# accept, so the same rows feed the library and the SQL oracle. Covers NULL
# and '' sectors, every TYPE and FINE_TYPE code and NULL drop reasons.
DETECTIONS_FROM_EVENTS_SQL = """
SELECT CAST(event_id AS STRING) AS ID,
       CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 4 WHEN 'error' THEN 5
                       WHEN 'click' THEN 6 ELSE 7 END AS TYPE,
       CASE WHEN event_id % 10 < 3 THEN 'MANUAL_VALIDATION'
            WHEN event_id % 10 = 9 THEN NULL ELSE 'AUTO' END AS PLATE_SOURCE,
       CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 11 = 1 THEN ''
            ELSE concat('SECTOR_', CAST(user_id % 11 AS STRING)) END AS SECTOR_NAME,
       CAST(CASE WHEN event_type IN ('click','signup') THEN
              CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 88 ELSE NULL END
            ELSE NULL END AS INT) AS FINE_TYPE,
       CAST(CASE WHEN event_type = 'error' AND event_id % 7 <> 0 THEN event_id % 4 ELSE NULL END
            AS INT) AS DROP_REASON,
       ts AS CREATED_DATE
FROM events
"""

# The same with values of the remaining types: double, long, int and an array
# of doubles. The two engines spell epoch milliseconds and arrays differently.
_SPELLING = {"spark": ("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)", "array(value, user_id / 2.0D)"),
             "duckdb": ("epoch_us(ts) // 1000", "[value, user_id / 2.0::DOUBLE]")}


def full_detections_sql(engine: str = "spark") -> str:
    """``DETECTIONS_FROM_EVENTS_SQL`` with CONFIDENCE_LEVEL, DETECTION_TIME,
    COORDINATES, STATUS and IMEI, for ``spark`` or ``duckdb``."""
    millis, pair = _SPELLING[engine]
    more = f""",
       value AS CONFIDENCE_LEVEL, {millis} AS DETECTION_TIME, {pair} AS COORDINATES,
       CAST(event_id % 10 AS INT) AS STATUS, CAST(user_id AS {'STRING' if engine == 'spark' else 'VARCHAR'}) AS IMEI
FROM events"""
    return DETECTIONS_FROM_EVENTS_SQL.replace("\nFROM events", more)


def _projection(columns: list[str], schema: StructType) -> list[str]:
    present = {name.lower(): name for name in columns}
    exprs = []
    for field in schema.fields:
        source = present.get(field.name.lower())
        value = quote_identifier(source) if source is not None else "NULL"
        exprs.append(f"CAST({value} AS {field.dataType.simpleString()}) AS {quote_identifier(field.name)}")
    return exprs


def conform(df: DataFrame, schema: StructType = DETECTIONS_SCHEMA) -> DataFrame:
    """Project ``df`` onto ``schema``: same names, order and types.

    Columns missing from ``df`` become typed NULLs; extra columns are dropped.
    Pure projection, so Catalyst still prunes whatever a query does not read.
    """
    exprs = [e.replace("{{", "{").replace("}}", "}") for e in _projection(df.columns, schema)]
    return df.selectExpr(*exprs)


# Columns produced by DETECTIONS_FROM_EVENTS_SQL.
_DERIVED = ["ID", "TYPE", "PLATE_SOURCE", "SECTOR_NAME", "FINE_TYPE", "DROP_REASON", "CREATED_DATE"]

_DETECTIONS_FROM_EVENTS = (
    "SELECT "
    + ",\n       ".join(_projection(_DERIVED, DETECTIONS_SCHEMA))
    + "\nFROM ("
    + DETECTIONS_FROM_EVENTS_SQL.replace("FROM events", "FROM {events}")
    + ")"
)


def detections_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Detections derived from an ``events`` DataFrame, with the full schema
    (one statement: the derivation and the projection onto the schema)."""
    return spark.sql(_DETECTIONS_FROM_EVENTS, events=events)


def load_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections derived from ``{sf_dir}/events.parquet``."""
    return detections_from_events(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))


def load_full_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with values of every type of the schema."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return conform(spark.sql(full_detections_sql().replace("FROM events", "FROM {events}"), events=events))
