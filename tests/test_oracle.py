"""Every registered query against its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as contract
from curbwatch.plans import scan_count
from tools.oracle_check import compare, duck_connection

from .conftest import SF001

REPORTS = contract._report_queries()  # the corpus operators have tests of their own
NAMES = list(REPORTS)


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF001)


def test_every_query_has_an_oracle():
    assert set(contract._report_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, SF001, name, contract.queries()[name], contract._report_sql().get(name), con)
    assert ok, msg


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith(("stream_", "refresh_", "detections_"))])
def test_every_query_scans_a_table(spark, name):
    """The others read files that they derived from the table themselves."""
    assert scan_count(REPORTS[name](spark, SF001)) >= 1


def test_queries_without_checkpoint_setting(spark):
    wrapped = contract._with_checkpoints(lambda s, d: s.range(1))
    assert wrapped(spark, SF001).count() == 1  # the folder that is set stays


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["metric", "id", "value"]
    assert df.count() == 5
