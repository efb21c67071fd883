import random
from collections import Counter

import pytest
from pyspark.errors import AnalysisException

from curbwatch.operators import (
    drop_reason_distribution,
    manual_review_count,
    master_report,
    master_scalars,
    sector_fine_distribution,
    sectors_count,
    transaction_count,
    transaction_type_distribution,
)

from .fixtures import empty_detections


def _report(df, filters):
    row = master_report(df, filters).collect()[0].asDict(recursive=True)
    return {
        "transactions": row["transactionCount"],
        "sectors": row["sectors"],
        "fines_per_sector": Counter((d["name"], d["value"]) for d in row["sectorsFineDistribution"]),
        "kinds": [(d["name"], d["value"]) for d in row["transactionTypesDistribution"]],
        "drops": Counter((d["name"], d["value"]) for d in row["droppedTransactionDistribution"]),
        "manual": row["manualReviewedTransactionCount"],
        "fines": row["finesCount"],
        "dropped": row["droppedCount"],
    }


def _by_metric(df, filters):
    """The same report assembled from one query per metric."""

    def scalar(frame):
        return frame.collect()[0][0]

    kinds = [(r["name"], r["value"]) for r in transaction_type_distribution(df, filters).collect()]
    kind_map = dict(kinds)
    return {
        "transactions": scalar(transaction_count(df, filters)),
        "sectors": scalar(sectors_count(df, filters)),
        "fines_per_sector": Counter(tuple(r) for r in sector_fine_distribution(df, filters).collect()),
        "kinds": kinds,
        "drops": Counter(tuple(r) for r in drop_reason_distribution(df, filters).collect()),
        "manual": scalar(manual_review_count(df, filters)),
        "fines": kind_map.get("fine", 0),
        "dropped": kind_map.get("dropped", 0),
    }


PAID, DROPPED, FINE = "PaidTransaction", "dropped", "fine"

# FIXTURES.md, fixture F1, master report table.
EDGE_CASES = [
    (None, 12, 4, {("North", 2): 1, (None, 1): 1, ("", 1): 1, ("Unknown", 1): 1},
     [(PAID, 2), (DROPPED, 3), (FINE, 5)], {(3, 2): 1, (None, 1): 1}, 4, 5, 3),
    ({"TYPE": {"$in": [6]}}, 2, 1, {("North", 2): 1}, [(FINE, 5)], {(3, 2): 1, (None, 1): 1}, 1, 5, 0),
    ({"TYPE": 6}, 2, 1, {("North", 2): 1}, [], {(3, 2): 1, (None, 1): 1}, 1, 0, 0),
    ({"SECTOR_NAME": "North"}, 4, 1, {("North", 2): 1}, [], {(None, 1): 1}, 3, 0, 0),
    ({"SECTOR_NAME": "North", "TYPE": {"$in": [1, 5]}}, 2, 0, {}, [(PAID, 1), (DROPPED, 1)], {(None, 1): 1}, 2, 0, 1),
    ({"TYPE": {"$in": []}}, 0, 0, {}, [], {(3, 2): 1, (None, 1): 1}, 0, 0, 0),
    ({"SECTOR_NAME": None}, 0, 0, {}, [], {}, 0, 0, 0),
]


@pytest.mark.parametrize("filters,txn,sectors,per_sector,kinds,drops,manual,fines,dropped", EDGE_CASES)
def test_edge_master_report(edge, filters, txn, sectors, per_sector, kinds, drops, manual, fines, dropped):
    expected = {
        "transactions": txn,
        "sectors": sectors,
        "fines_per_sector": Counter(per_sector),
        "kinds": kinds,
        "drops": Counter(drops),
        "manual": manual,
        "fines": fines,
        "dropped": dropped,
    }
    assert _report(edge, filters) == expected
    assert _by_metric(edge, filters) == expected


def test_caller_filter_not_mutated(edge):
    filters = {"TYPE": {"$in": [6]}, "SECTOR_NAME": "North"}
    before = {"TYPE": {"$in": [6]}, "SECTOR_NAME": "North"}
    _report(edge, filters)
    _by_metric(edge, filters)
    assert filters == before


def test_unknown_column_raises(edge):
    with pytest.raises(AnalysisException):
        master_report(edge, {"NO_SUCH_COLUMN": 1}).collect()


def test_lower_case_type_key_is_a_plain_filter(edge):
    # Only the exact key TYPE is special; "type" filters every metric and
    # the type distribution reports nothing (as for any non-TYPE filter).
    got = _report(edge, {"type": {"$in": [6]}})
    assert got["transactions"] == 2 and got["kinds"] == [] and got["drops"] == Counter()


def _random_filters(rng):
    filters = {}
    if rng.random() < 0.7:
        choice = rng.random()
        if choice < 0.15:
            filters["TYPE"] = rng.choice([1, 4, 5, 6, 7, 0, None])
        elif choice < 0.25:
            filters["TYPE"] = {"$in": []}
        else:
            members = rng.sample([1, 4, 5, 6, 7, None], rng.randint(1, 4))
            filters["TYPE"] = {"$in": members}
    if rng.random() < 0.4:
        filters["SECTOR_NAME"] = rng.choice(["North", "South", "SECTOR_3", "SECTOR_5", "", "Unknown"])
    if rng.random() < 0.3:
        filters["PLATE_SOURCE"] = rng.choice(["AUTO", "MANUAL_VALIDATION", {"$in": ["AUTO", "MANUAL_VALIDATION"]}])
    if rng.random() < 0.2:
        filters["FINE_TYPE"] = rng.choice([1, 2, 5, 88, {"$in": [1, 88]}])
    return filters


@pytest.mark.parametrize("seed", range(12))
def test_single_scan_equals_by_metric(edge, f2, seed):
    rng = random.Random(seed)
    for df in (edge, f2):
        filters = _random_filters(rng)
        assert _report(df, filters) == _by_metric(df, filters), filters


def test_conservation_unfiltered(f2):
    got = _report(f2, None)
    kinds = dict(got["kinds"])
    assert sum(v * n for (_, v), n in got["fines_per_sector"].items()) == kinds[FINE]
    assert sum(v * n for (_, v), n in got["drops"].items()) == kinds[DROPPED]
    assert got["transactions"] == f2.count()


def test_fixture_f2_master(f2):
    got = _report(f2, None)
    assert got["kinds"] == [(PAID, 202), (DROPPED, 201), (FINE, 409)]
    assert got["sectors"] == 11 and len(got["drops"]) == 5 and got["manual"] == 300


def test_empty_input(spark):
    empty = empty_detections(spark)
    got = _report(empty, None)
    assert got == {
        "transactions": 0,
        "sectors": 0,
        "fines_per_sector": Counter(),
        "kinds": [(PAID, 0), (DROPPED, 0), (FINE, 0)],
        "drops": Counter(),
        "manual": 0,
        "fines": 0,
        "dropped": 0,
    }
    assert master_scalars(empty, {"TYPE": {"$in": [6]}}).collect()[0].asDict() == {
        "transactionCount": 0,
        "sectors": 0,
        "manualReviewedTransactionCount": 0,
        "finesCount": 0,
        "droppedCount": 0,
    }
    assert sector_fine_distribution(empty).count() == 0
    assert drop_reason_distribution(empty).count() == 0
