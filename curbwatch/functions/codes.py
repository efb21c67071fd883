"""SQL conditions over the detections code tables.

The reports are SQL statements; these are the conditions they are built
from, one place for every code the reports interpret.
"""

from __future__ import annotations

from ..schema import (
    KIND_DROPPED,
    KIND_FINE,
    KIND_PAID,
    MANUAL_VALIDATION,
    TYPE_DROPPED,
    TYPE_FINE,
    TYPE_PAID,
    UNKNOWN_SECTOR,
)

# Report order of the transaction kinds and the TYPE codes of each.
KINDS = {KIND_PAID: (TYPE_PAID,), KIND_DROPPED: (TYPE_DROPPED,), KIND_FINE: TYPE_FINE}


def type_in(codes: tuple[int, ...]) -> str:
    """``TYPE`` is one of ``codes``."""
    return f"TYPE = {codes[0]}" if len(codes) == 1 else f"TYPE IN ({', '.join(str(c) for c in codes)})"


IS_FINE = type_in(TYPE_FINE)
IS_DROPPED = type_in((TYPE_DROPPED,))

# Rows of any transaction kind.
IS_COUNTED_KIND = type_in(tuple(code for codes in KINDS.values() for code in codes))

# Manually reviewed: exact, case-sensitive match.
IS_MANUAL = f"PLATE_SOURCE = '{MANUAL_VALIDATION}'"


def has_fine_code(code: int) -> str:
    return f"FINE_TYPE = {code}"


# NULL or '' sector -> 'Unknown'. Applied after grouping on the raw name, so
# NULL, '' and a literal 'Unknown' stay three groups with the same label.
SECTOR_LABEL = f"CASE WHEN SECTOR_NAME IS NULL OR SECTOR_NAME = '' THEN '{UNKNOWN_SECTOR}' ELSE SECTOR_NAME END"
