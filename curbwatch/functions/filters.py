"""Filter dictionaries compiled to one Spark predicate.

A filter is a mapping ``column -> value`` where value is either a scalar
(equality, ``col = value``) or ``{"$in": [v, ...]}`` (membership). All
entries are AND-ed. Everything compiles to native Catalyst predicates, so
they reach the scan as pushed filters.

Semantics kept on purpose (three-valued SQL logic):

* ``None`` or ``{}`` as the whole filter: no condition.
* ``{"col": None}`` is ``col = NULL``: no rows (it is not "is null").
* ``{"$in": []}``: no rows; ``{"$in": [6, None]}``: rows with 6 only.
* Column names resolve like Spark does (case-insensitive by default); an
  unknown column raises ``AnalysisException``.

Rejected up front with ``ValueError``: lists/sets/dicts as an equality value,
an ``$in`` that is not a list, and operators other than ``$in``.

One compiler: ``filter_clause`` builds SQL text with named parameter markers
(values are bound, never spliced into the text). The reports put it into their
statements and ``apply_filters`` runs it on its own, so a key means the same
column everywhere: the column of exactly this name, whatever characters it has.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

IN = "$in"
TYPE_KEY = "TYPE"

_SCALARS = (type(None), bool, int, float, str, decimal.Decimal, datetime.date, datetime.datetime)


def _check_scalar(key: str, value: Any) -> None:
    if not isinstance(value, _SCALARS):
        raise ValueError(f"filter on {key!r}: unsupported value {value!r}; use a scalar or {{'{IN}': [...]}}")


def _members(key: str, value: Any) -> list | None:
    """Validate one entry; the ``$in`` members, or ``None`` for a scalar."""
    if isinstance(value, Mapping):
        if set(value) != {IN}:
            raise ValueError(f"filter on {key!r}: only {{'{IN}': [...]}} is supported, got {dict(value)!r}")
        members = value[IN]
        if not isinstance(members, (list, tuple, set, frozenset)):
            raise ValueError(f"filter on {key!r}: {IN} needs a list, got {members!r}")
        for member in members:
            _check_scalar(key, member)
        return list(members)
    _check_scalar(key, value)
    return None


def quote_identifier(name: str) -> str:
    """``name`` as a quoted SQL identifier, safe inside a ``{}``-formatted
    statement (braces doubled)."""
    quoted = "`" + name.replace("`", "``") + "`"
    return quoted.replace("{", "{{").replace("}", "}}")


def filter_clause(filters: Mapping[str, Any] | None, prefix: str = "f") -> tuple[str, dict[str, Any]]:
    """SQL predicate text for ``filters`` and its parameter values.

    ``TRUE`` when there is no condition; an empty ``$in`` is ``FALSE``.
    Parameter names are ``{prefix}{i}`` / ``{prefix}{i}_{j}``.
    """
    if not filters:
        return "TRUE", {}
    parts: list[str] = []
    args: dict[str, Any] = {}
    for i, (key, value) in enumerate(filters.items()):
        column = quote_identifier(key)
        members = _members(key, value)
        if members is None:
            args[f"{prefix}{i}"] = value
            parts.append(f"{column} = :{prefix}{i}")
        elif not members:
            parts.append("FALSE")
        else:
            names = [f"{prefix}{i}_{j}" for j in range(len(members))]
            args.update(zip(names, members))
            parts.append(f"{column} IN ({', '.join(':' + n for n in names)})")
    return " AND ".join(parts), args


def apply_filters(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """``df`` restricted to rows matching every entry; unchanged when empty."""
    if not filters:
        return df
    where, args = filter_clause(filters)
    return df.sparkSession.sql(f"SELECT * FROM {{d}} AS src WHERE {where}", args=args or None, d=df)


def split_type_filter(filters: Mapping[str, Any] | None) -> tuple[dict[str, Any] | None, dict[str, Any]]:
    """Split off the ``TYPE`` entry: ``({"TYPE": value} or None, other entries)``.

    Only the exact key ``TYPE`` is split off (and validated); the caller's
    mapping is not modified.
    """
    rest = dict(filters or {})
    if TYPE_KEY not in rest:
        return None, rest
    value = rest.pop(TYPE_KEY)
    _members(TYPE_KEY, value)
    return {TYPE_KEY: value}, rest


def emitted_kinds(filters: Mapping[str, Any] | None, kinds: Mapping[str, tuple[int, ...]]) -> list[str]:
    """Transaction kinds a type distribution reports for ``filters``.

    All kinds when there is no filter at all. Otherwise only with a
    ``TYPE: {"$in": [...]}`` entry, and then each kind whose codes meet the
    list. Any other filter (a scalar TYPE, or no TYPE entry) reports none.
    """
    if not filters:
        return list(kinds)
    if TYPE_KEY not in filters:
        return []
    members = _members(TYPE_KEY, filters[TYPE_KEY])
    if members is None:
        return []
    return [name for name, codes in kinds.items() if any(m == c for m in members for c in codes)]
