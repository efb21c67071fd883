from .collections import CollectionRegistry
from .detections import (
    DETECTIONS_FROM_EVENTS_SQL,
    conform,
    detections_from_events,
    full_detections_sql,
    load_detections,
    load_full_detections,
)
from .messages import payloads_from_events

__all__ = [
    "DETECTIONS_FROM_EVENTS_SQL",
    "CollectionRegistry",
    "conform",
    "detections_from_events",
    "full_detections_sql",
    "load_detections",
    "load_full_detections",
    "payloads_from_events",
]
