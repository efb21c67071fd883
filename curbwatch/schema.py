"""Declared schemas and code tables.

Both schemas are fixed and declared up front: sources are always read with
them, never with schema inference, and every field is nullable.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# --- Fixed values: must equal the source system's column names, types and
# --- order, since documents are read by name with this schema.
DETECTIONS_SCHEMA = StructType(
    [
        StructField("ID", StringType(), True),
        StructField("TYPE", IntegerType(), True),
        StructField("PLATE_SOURCE", StringType(), True),
        StructField("PLATE_REGION", StringType(), True),
        StructField("PLATE_COLOR", StringType(), True),
        StructField("PLATE_CODE", StringType(), True),
        StructField("PLATE_NUMBER", StringType(), True),
        StructField("PLATE_TYPE", StringType(), True),
        StructField("CONFIDENCE_LEVEL", DoubleType(), True),
        StructField("CONFIDENCE_LEVEL_PERCENTAGE", IntegerType(), True),
        StructField("VEHICLE_MAKE", StringType(), True),
        StructField("VEHICLE_MODEL", StringType(), True),
        StructField("VEHICLE_COLOR", StringType(), True),
        StructField("VEHICLE_TYPE", StringType(), True),
        StructField("IMEI", StringType(), True),
        StructField("CHANNEL", IntegerType(), True),
        StructField("SPEED", IntegerType(), True),
        StructField("HEADING", IntegerType(), True),
        StructField("DETECTION_TIME", LongType(), True),
        StructField("DETECTED_ID", StringType(), True),
        StructField("IMAGES_COUNT", IntegerType(), True),
        StructField("ASSET_ID", StringType(), True),
        StructField("CREW_ID", StringType(), True),
        StructField("TRIP_ID", StringType(), True),
        StructField("ASSIGNED_OPERATOR", StringType(), True),
        StructField("PARKING_TYPE", StringType(), True),
        StructField("SECTOR_NAME", StringType(), True),
        StructField("SECTOR_ID", IntegerType(), True),
        StructField("LOT_ID", StringType(), True),
        StructField("LOT_TYPE", StringType(), True),
        StructField("LOT_TARRIF", StringType(), True),
        StructField("COORDINATES", ArrayType(DoubleType()), True),
        StructField("STATUS", IntegerType(), True),
        StructField("CREATED_DATE", TimestampType(), True),
        StructField("FINE_TYPE", IntegerType(), True),
        StructField("FINE_ACTION", IntegerType(), True),
        StructField("timestamp", TimestampType(), True),
        StructField("DROP_DESCRIPTION", StringType(), True),
        StructField("DROP_REASON", IntegerType(), True),
        StructField("UPDATED_BY", StringType(), True),
    ]
)

# --- Fixed values: device message payload (JSON field names are case sensitive).
STREAM_SCHEMA = StructType(
    [
        StructField("imei", StringType(), True),
        StructField("time", StringType(), True),
        StructField("status", IntegerType(), True),
        StructField("assetId", StringType(), True),
        StructField("crewId", StringType(), True),
        StructField("timestamp", StringType(), True),
    ]
)

# --- Fixed values: fine codes (FINE_TYPE column).
FINE_TYPES = {
    "TicketPermitNotDisplayedClearly": 1,
    "InvalidTicketOrPermit": 2,
    "OverStay": 5,
    "illegalParking": 88,
}

# --- Fixed values: transaction kinds (TYPE column) and the manual-review marker.
TYPE_PAID = 1
TYPE_DROPPED = 5
TYPE_FINE = (6, 7)
MANUAL_VALIDATION = "MANUAL_VALIDATION"

# --- Fixed values: report labels and keys as they appear in report documents.
UNKNOWN_SECTOR = "Unknown"
KIND_PAID = "PaidTransaction"
KIND_DROPPED = "dropped"
KIND_FINE = "fine"

# --- Fixed values: fine-report metrics in document order: (document key, id). Id 0 is the
# total over all rows; the others are FINE_TYPE codes. The first key is
# spelled as in the report documents consumers already parse.
FINE_METRICS = (
    ("toratalViolationCount", 0),
    ("illegalParkingViolationCount", FINE_TYPES["illegalParking"]),
    ("notPaidViolationCount", FINE_TYPES["TicketPermitNotDisplayedClearly"]),
    ("notAuthorizedViolationCount", FINE_TYPES["InvalidTicketOrPermit"]),
    ("overStayViolationCount", FINE_TYPES["OverStay"]),
)

# --- Fixed values: change-feed operation types that trigger a refresh.
REFRESH_OPERATIONS = ("insert", "update", "replace", "delete")
