"""Read a DataFrame's physical plan: scans, read schemas, pushed filters.

Used by the plan tests to hold the reports to one scan with pruned columns.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buffer = io.StringIO()
    with contextlib.redirect_stdout(buffer):
        df.explain(mode=mode)
    return buffer.getvalue()


def scan_count(df: DataFrame) -> int:
    """Number of file-scan nodes in the physical plan."""
    return len(re.findall(r"^\(\d+\) Scan (?!OneRowRelation)\w+", plan_text(df), flags=re.MULTILINE))


def read_schemas(df: DataFrame) -> list[str]:
    """The ``ReadSchema`` of every scan."""
    return re.findall(r"^ReadSchema: (.*)$", plan_text(df), flags=re.MULTILINE)


def pushed_filters(df: DataFrame) -> list[str]:
    """The ``PushedFilters`` of every scan."""
    return re.findall(r"^PushedFilters: (.*)$", plan_text(df), flags=re.MULTILINE)


def exchange_count(df: DataFrame) -> int:
    """Number of shuffle exchanges in the physical plan."""
    return len(re.findall(r"^\(\d+\) Exchange", plan_text(df), flags=re.MULTILINE))


def plan_nodes(df: DataFrame) -> list[tuple[int, str, str]]:
    """``(id, operator, details)`` of every node of the formatted plan, in id
    order (children before parents)."""
    text = plan_text(df)
    parts = re.split(r"^\((\d+)\) ([A-Za-z]+)[^\n]*\n", text, flags=re.MULTILINE)
    nodes = []
    for i in range(1, len(parts) - 2, 3):
        nodes.append((int(parts[i]), parts[i + 1], parts[i + 2]))
    return nodes


def exchanges_after_partial_aggregates(df: DataFrame) -> bool:
    """Every shuffle exchange reads the output of a partial (map-side)
    aggregate, so it carries pre-combined rows, never raw ones."""
    nodes = {node_id: (name, details) for node_id, name, details in plan_nodes(df)}
    for node_id, (name, _) in nodes.items():
        if name != "Exchange":
            continue
        child = nodes.get(node_id - 1)
        if child is None or not child[0].endswith("HashAggregate"):
            return False
        # map-side aggregate: partial functions, or keys only (a DISTINCT)
        if "partial_" not in child[1] and "Functions: []" not in child[1]:
            return False
    return True
