"""Message feeds derived from the ``events`` table.

These turn a given table into the inputs of the streaming pipelines, so the streaming paths run over data that grows
with the table rather than over a fixed sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _payload(status: Column) -> Column:
    return F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("imei"),
            F.col("event_id").cast("string").alias("time"),
            status.alias("status"),
            F.col("event_type").alias("assetId"),
            F.col("event_type").alias("crewId"),
            F.col("event_id").cast("string").alias("timestamp"),
        )
    )


def payloads_from_events(events: DataFrame) -> DataFrame:
    """One JSON payload per event in column ``value``.

    imei = user_id, time = timestamp = event_id, status = event_id % 10,
    assetId = crewId = event_type. Two event types carry faults: ``error``
    events send status as a JSON string (decodes to NULL status) and ``view``
    events send text that is not JSON (decodes to all NULLs).
    """
    status = (F.col("event_id") % 10).cast("int")
    value = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("{bad "), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "error", _payload(status.cast("string")))
        .otherwise(_payload(status))
    )
    return events.select(value.alias("value"))
