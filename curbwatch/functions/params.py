"""Fine-report request parameters: validate and keep the ones given."""

from __future__ import annotations

from typing import Any

# --- Fixed values: bounds of the request parameters.
SECTOR_NAME_LENGTH = (3, 50)


def fine_report_params(
    sector_name: str | None = None,
    start_date: int | None = None,
    end_date: int | None = None,
    fine_type: int | None = None,
) -> dict[str, Any]:
    """Validated request parameters without the absent ones.

    ``sector_name`` must be 3 to 50 characters; the others integers >= 0.
    Raises ``ValueError`` otherwise.
    """
    if sector_name is not None:
        if not isinstance(sector_name, str):
            raise ValueError("sector_name must be a string")
        low, high = SECTOR_NAME_LENGTH
        if not low <= len(sector_name) <= high:
            raise ValueError(f"sector_name must have {low} to {high} characters")
    for name, value in (("start_date", start_date), ("end_date", end_date), ("fine_type", fine_type)):
        if value is None:
            continue
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(f"{name} must be an integer")
        if value < 0:
            raise ValueError(f"{name} must be >= 0")
    given = {"sector_name": sector_name, "start_date": start_date, "end_date": end_date, "fine_type": fine_type}
    return {k: v for k, v in given.items() if v is not None}
