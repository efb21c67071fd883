"""Fixture F1 (FIXTURES.md): twelve detections covering the edge rules."""

from pyspark.sql import SparkSession

from curbwatch.schema import DETECTIONS_SCHEMA
from curbwatch.sources import conform

# (ID, TYPE, SECTOR_NAME, FINE_TYPE, DROP_REASON, PLATE_SOURCE)
EDGE_ROWS = [
    ("1", 6, "North", 88, None, "AUTO"),
    ("2", 6, "North", 1, None, "MANUAL_VALIDATION"),
    ("3", 7, None, 2, None, "AUTO"),
    ("4", 7, "", 5, None, None),
    ("5", 7, "Unknown", 88, None, "MANUAL_VALIDATION"),
    ("6", 1, "South", None, None, "AUTO"),
    ("7", 1, "North", None, None, "MANUAL_VALIDATION"),
    ("8", 5, "South", None, 3, "AUTO"),
    ("9", 5, "North", None, None, "MANUAL_VALIDATION"),
    ("10", 5, None, 1, 3, "AUTO"),
    ("11", 4, "East", None, None, "AUTO"),
    ("12", None, "East", 99, None, "manual_validation"),
]

EDGE_SCHEMA = "ID string, TYPE int, SECTOR_NAME string, FINE_TYPE int, DROP_REASON int, PLATE_SOURCE string"


def edge_detections(spark: SparkSession):
    return conform(spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA), DETECTIONS_SCHEMA)


def empty_detections(spark: SparkSession):
    return spark.createDataFrame([], DETECTIONS_SCHEMA)
