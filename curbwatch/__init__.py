"""curbwatch: parking-detection reports and device-message ingest on Spark."""

from .schema import DETECTIONS_SCHEMA, FINE_TYPES, STREAM_SCHEMA

__all__ = ["DETECTIONS_SCHEMA", "FINE_TYPES", "STREAM_SCHEMA"]
