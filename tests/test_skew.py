"""One sector holds a third of all rows: results stay exact and the
pre-aggregate stays small (bounded by groups, not rows)."""

from collections import Counter

import pytest

from curbwatch.operators import master_partials, master_report, sector_counts, sector_fine_distribution, sectors_count
from curbwatch.plans import exchange_count, exchanges_after_partial_aggregates
from curbwatch.sources import conform

N = 30000


@pytest.fixture(scope="module")
def skewed(spark):
    raw = spark.range(N, numPartitions=12).selectExpr(
        "CAST(id AS STRING) AS ID",
        "CAST(element_at(array(1, 4, 5, 6, 7), CAST(id % 5 AS INT) + 1) AS INT) AS TYPE",
        "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('S', CAST(id % 40 AS STRING)) END AS SECTOR_NAME",
        "CASE WHEN id % 7 = 0 THEN 'MANUAL_VALIDATION' ELSE 'AUTO' END AS PLATE_SOURCE",
        "CAST(CASE WHEN id % 5 = 2 THEN id % 6 END AS INT) AS DROP_REASON",
        "CAST(CASE WHEN id % 4 = 0 THEN 88 ELSE 1 END AS INT) AS FINE_TYPE",
    )
    return conform(raw).cache()


def test_hot_sector_counts_exact(skewed):
    counts = {r["name"]: r["value"] for r in sector_counts(skewed).collect()}
    assert counts["HOT"] == N // 3
    assert sum(counts.values()) == N


def test_partials_bounded_by_groups(skewed):
    partials = master_partials(skewed).collect()
    sectors = {r["sector"] for r in partials if r["role"] == 1}
    reasons = {r["reason"] for r in partials if r["role"] == 2}
    assert len(partials) <= 1 + len(sectors) + len(reasons)
    assert sum(r["n"] for r in partials) == N


def test_master_report_on_skewed_data(skewed):
    row = master_report(skewed).collect()[0]
    dist = Counter({d["name"]: d["value"] for d in row["sectorsFineDistribution"]})
    expected = Counter({r["name"]: r["value"] for r in sector_fine_distribution(skewed).collect()})
    assert dist == expected
    assert row["transactionCount"] == N
    assert sum(d["value"] for d in row["droppedTransactionDistribution"]) == row["droppedCount"]


@pytest.mark.parametrize("build", [master_report, sector_counts, sector_fine_distribution, sectors_count])
def test_every_shuffle_is_pre_aggregated(skewed, build):
    assert exchange_count(build(skewed)) >= 1
    assert exchanges_after_partial_aggregates(build(skewed))
