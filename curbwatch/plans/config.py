"""Runtime settings for the report jobs on large tables.

The reports are scans feeding small aggregates: tasks hold a handful of
hash-aggregate keys and stream through their split, so large splits are safe
and cut task count (100 TB / 128 MB is ~800k tasks; at 1 GB, ~100k). The
shuffles after the partial aggregates carry a few rows per task, so few
shuffle partitions suffice; AQE coalesces them further.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

REPORT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "1g",
    "spark.sql.shuffle.partitions": "64",
    "spark.sql.parquet.filterPushdown": "true",
}


def configure_reports(spark: SparkSession, **overrides: str) -> dict[str, str]:
    """Apply ``REPORT_CONF`` (plus overrides) to the session's SQL conf and
    return the previous values, for ``restore``."""
    settings = {**REPORT_CONF, **overrides}
    previous = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    return previous


def restore(spark: SparkSession, previous: dict[str, str | None]) -> None:
    for key, value in previous.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
