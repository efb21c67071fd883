from collections import Counter

from curbwatch.operators import (
    fine_counts,
    fine_counts_from_report,
    fine_counts_from_rows,
    fine_report,
    fine_report_rows,
    section_rows,
    sector_counts,
)
from curbwatch.operators.master_report import explode_distribution

from .fixtures import empty_detections


def _counts(df):
    return {(r["metric"], r["id"]): r["value"] for r in df.collect()}


def test_edge_fine_counts(edge):
    got = _counts(fine_counts(edge))
    assert got == {
        ("toratalViolationCount", 0): 12,
        ("illegalParkingViolationCount", 88): 2,
        ("notPaidViolationCount", 1): 2,
        ("notAuthorizedViolationCount", 2): 1,
        ("overStayViolationCount", 5): 1,
    }


def test_edge_sectors_three_unknown_rows(edge):
    got = Counter((r["name"], r["value"]) for r in sector_counts(edge).collect())
    assert got == Counter(
        {("North", 4): 1, ("South", 2): 1, ("East", 2): 1, ("Unknown", 2): 1, ("Unknown", 1): 2}
    )


def test_single_scan_report_equals_parts(f2):
    report = fine_report(f2).cache()
    assert _counts(fine_counts_from_report(report)) == _counts(fine_counts(f2))
    parts = Counter(tuple(r) for r in explode_distribution(report, "sectors").collect())
    assert parts == Counter(tuple(r) for r in sector_counts(f2).collect())
    report.unpersist()
    rows = fine_report_rows(f2)
    assert _counts(fine_counts_from_rows(rows)) == _counts(fine_counts(f2))
    assert Counter(tuple(r) for r in section_rows(rows, "sectors").collect()) == parts


def test_conservation_sectors_sum_to_total(f2):
    total = sum(r["value"] for r in sector_counts(f2).collect())
    assert total == _counts(fine_counts(f2))[("toratalViolationCount", 0)] == f2.count()


def test_empty_input(spark):
    empty = empty_detections(spark)
    got = _counts(fine_counts(empty))
    assert len(got) == 5 and set(got.values()) == {0}
    assert sector_counts(empty).count() == 0
    assert sorted(r["value"] for r in fine_report_rows(empty).collect()) == [0] * 5
    row = fine_report(empty).collect()[0]
    assert row["toratalViolationCount"]["value"] == 0 and row["sectors"] == []


def test_fixture_f2_values(f2):
    got = _counts(fine_counts(f2))
    assert got[("toratalViolationCount", 0)] == 1000
    assert got[("notPaidViolationCount", 1)] == 83
    assert got[("notAuthorizedViolationCount", 2)] == 84
