"""Master and fine reports against a brute-force Python model, on random
filters over small fixtures (F1 and the events-derived F2 at sf0.001).

The model evaluates every filter entry row by row with SQL's three-valued
logic (a comparison with NULL is never true) and applies the report rules
directly; it shares no code with the library.
"""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from curbwatch.operators import fine_report, master_report

from .fixtures import EDGE_ROWS

COLUMNS = ["ID", "TYPE", "SECTOR_NAME", "FINE_TYPE", "DROP_REASON", "PLATE_SOURCE"]


def _holds(row, key, value):
    column = next(c for c in row if c.lower() == key.lower())
    actual = row[column]
    if isinstance(value, dict):
        return actual is not None and any(m is not None and actual == m for m in value["$in"])
    return actual is not None and value is not None and actual == value


def _where(rows, filters):
    return [r for r in rows if all(_holds(r, k, v) for k, v in filters.items())]


def model_master(rows, filters):
    filters = filters or {}
    rest = {k: v for k, v in filters.items() if k != "TYPE"}
    selected, base = _where(rows, filters), _where(rows, rest)
    fines = [r for r in selected if r["TYPE"] in (6, 7)]
    counts = {
        "PaidTransaction": sum(r["TYPE"] == 1 for r in base),
        "dropped": sum(r["TYPE"] == 5 for r in base),
        "fine": sum(r["TYPE"] in (6, 7) for r in base),
    }
    if not filters:
        kinds = list(counts)
    elif isinstance(filters.get("TYPE"), dict):
        members = filters["TYPE"]["$in"]
        codes = {"PaidTransaction": (1,), "dropped": (5,), "fine": (6, 7)}
        kinds = [k for k in counts if any(m == c for m in members for c in codes[k])]
    else:
        kinds = []
    return {
        "transactionCount": len(selected),
        "sectors": len({r["SECTOR_NAME"] for r in fines}),
        "sectorsFineDistribution": Counter(Counter(r["SECTOR_NAME"] for r in fines).items()),
        "transactionTypesDistribution": [(k, counts[k]) for k in kinds],
        "droppedTransactionDistribution": Counter(Counter(r["DROP_REASON"] for r in base if r["TYPE"] == 5).items()),
        "manualReviewedTransactionCount": sum(r["PLATE_SOURCE"] == "MANUAL_VALIDATION" for r in selected),
        "finesCount": counts["fine"] if "fine" in kinds else 0,
        "droppedCount": counts["dropped"] if "dropped" in kinds else 0,
    }


def model_fine(rows):
    sectors = Counter(r["SECTOR_NAME"] for r in rows)
    return {
        "counts": {
            0: len(rows),
            88: sum(r["FINE_TYPE"] == 88 for r in rows),
            1: sum(r["FINE_TYPE"] == 1 for r in rows),
            2: sum(r["FINE_TYPE"] == 2 for r in rows),
            5: sum(r["FINE_TYPE"] == 5 for r in rows),
        },
        "sectors": Counter((name or "Unknown", n) for name, n in sectors.items()),
    }


def spark_master(df, filters):
    row = master_report(df, filters).collect()[0].asDict(recursive=True)
    for key in ("sectorsFineDistribution", "droppedTransactionDistribution"):
        row[key] = Counter((d["name"], d["value"]) for d in row[key])
    row["transactionTypesDistribution"] = [(d["name"], d["value"]) for d in row["transactionTypesDistribution"]]
    return row


@pytest.fixture(scope="module")
def edge_rows():
    return [dict(zip(COLUMNS, r)) for r in EDGE_ROWS]


@pytest.fixture(scope="module")
def f2_rows(f2):
    return [r.asDict() for r in f2.select(*COLUMNS).collect()]


scalars = st.sampled_from([1, 4, 5, 6, 7, 0, 88, None])
type_values = st.one_of(scalars, st.lists(scalars, max_size=4).map(lambda m: {"$in": m}))
sector_values = st.sampled_from(["North", "South", "East", "", "Unknown", "SECTOR_3", "SECTOR_7", None])
filters_strategy = st.fixed_dictionaries(
    {},
    optional={
        "TYPE": type_values,
        "SECTOR_NAME": st.one_of(sector_values, st.lists(sector_values, max_size=3).map(lambda m: {"$in": m})),
        "PLATE_SOURCE": st.sampled_from(["AUTO", "MANUAL_VALIDATION", {"$in": ["AUTO", None]}]),
        "FINE_TYPE": st.sampled_from([1, 2, 5, 88, {"$in": [1, 88]}, None]),
        "type": st.sampled_from([6, {"$in": [1, 5]}]),
    },
)

SETTINGS = settings(
    max_examples=20, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


@SETTINGS
@given(filters=filters_strategy)
def test_master_report_matches_model_on_edge(edge, edge_rows, filters):
    assert spark_master(edge, filters) == model_master(edge_rows, filters), filters


@SETTINGS
@given(filters=filters_strategy)
def test_master_report_matches_model_on_events(f2, f2_rows, filters):
    assert spark_master(f2, filters) == model_master(f2_rows, filters), filters


def test_fine_report_matches_model(edge, edge_rows, f2, f2_rows):
    for df, rows in ((edge, edge_rows), (f2, f2_rows)):
        row = fine_report(df).collect()[0].asDict(recursive=True)
        got = {
            "counts": {
                row[key]["id"]: row[key]["value"]
                for key in (
                    "toratalViolationCount",
                    "illegalParkingViolationCount",
                    "notPaidViolationCount",
                    "notAuthorizedViolationCount",
                    "overStayViolationCount",
                )
            },
            "sectors": Counter((d["name"], d["value"]) for d in row["sectors"]),
        }
        assert got == model_fine(rows)


@settings(max_examples=25, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(filters=filters_strategy)
def test_column_and_sql_filter_forms_agree(spark, edge, edge_rows, filters):
    from curbwatch.functions import apply_filters, filter_clause

    by_column = sorted(r["ID"] for r in apply_filters(edge, filters).select("ID").collect())
    where, args = filter_clause(filters)
    by_sql = sorted(r["ID"] for r in spark.sql(f"SELECT ID FROM {{d}} AS src WHERE {where}", args=args, d=edge).collect())
    assert by_column == by_sql == sorted(r["ID"] for r in _where(edge_rows, filters))
