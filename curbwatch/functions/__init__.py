from .codes import IS_COUNTED_KIND, IS_DROPPED, IS_FINE, IS_MANUAL, KINDS, SECTOR_LABEL, has_fine_code, type_in
from .filters import (
    IN,
    TYPE_KEY,
    apply_filters,
    emitted_kinds,
    filter_clause,
    quote_identifier,
    split_type_filter,
)
from .params import fine_report_params

__all__ = [
    "IN",
    "IS_COUNTED_KIND",
    "IS_DROPPED",
    "IS_FINE",
    "IS_MANUAL",
    "KINDS",
    "SECTOR_LABEL",
    "TYPE_KEY",
    "apply_filters",
    "emitted_kinds",
    "filter_clause",
    "fine_report_params",
    "has_fine_code",
    "quote_identifier",
    "split_type_filter",
    "type_in",
]
