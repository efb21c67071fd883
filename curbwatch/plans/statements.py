"""Run one SQL statement over a DataFrame.

A report is a single statement: Spark parses and analyses it in one call,
instead of one driver round trip per Column object, and Catalyst plans it
exactly as the equivalent DataFrame code. ``{d}`` in the text stands for the
source; values come in as named parameters (``:name``), never as text.

The statement runs in the DataFrame's own session. A collection known by name
is fetched from its registry first (``CollectionRegistry.get``).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

Source = DataFrame


def run_statement(source: Source, text: str, args: dict[str, Any] | None = None) -> DataFrame:
    """``text`` with ``{d}`` bound to ``source``."""
    return source.sparkSession.sql(text, args=args or None, d=source)
