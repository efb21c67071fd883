"""Plan checks: one scan per report, pruned read schema, pushed filters,
partial aggregation before every shuffle."""

import pytest

from curbwatch.operators import (
    fine_counts,
    fine_report,
    fine_report_document,
    fine_report_rows,
    master_report,
    master_report_document,
    master_report_rows,
    transaction_type_distribution,
)
from curbwatch.plans import (
    exchange_count,
    exchanges_after_partial_aggregates,
    plan_text,
    pushed_filters,
    read_schemas,
    scan_count,
)
from curbwatch.schema import DETECTIONS_SCHEMA

from .fixtures import edge_detections

REPORT_READ = {"TYPE", "FINE_TYPE", "SECTOR_NAME", "DROP_REASON", "PLATE_SOURCE"}


@pytest.fixture(scope="module")
def table(spark):
    from curbwatch.session import shared_dir

    path = shared_dir(spark, "plan_table")
    edge_detections(spark).write.parquet(path)
    return spark.read.schema(DETECTIONS_SCHEMA).parquet(path)


def _read_columns(df):
    (schema,) = read_schemas(df)
    return {part.split(":")[0] for part in schema[len("struct<"):-1].split(",")}


@pytest.mark.parametrize(
    "build",
    [
        lambda t: fine_report(t),
        lambda t: fine_report_document(t),
        lambda t: master_report(t),
        lambda t: master_report_document(t, {"TYPE": {"$in": [6]}, "SECTOR_NAME": "North"}),
    ],
)
def test_one_scan_per_report(table, build):
    df = build(table)
    assert scan_count(df) == 1
    assert _read_columns(df) <= REPORT_READ


def test_fine_counts_reads_one_column(table):
    assert _read_columns(fine_counts(table)) == {"FINE_TYPE"}


def test_filters_reach_the_scan(table):
    df = master_report(table, {"SECTOR_NAME": "North", "PLATE_SOURCE": {"$in": ["AUTO"]}, "TYPE": {"$in": [6]}})
    (pushed,) = pushed_filters(df)
    assert "EqualTo(SECTOR_NAME,North)" in pushed
    assert "In(PLATE_SOURCE" in pushed or "EqualTo(PLATE_SOURCE,AUTO)" in pushed
    # the TYPE entry itself is evaluated inside the counts; the scan gets
    # the exact relevance condition "t OR TYPE IN (1, 5, 6, 7)"
    assert "Or(In(TYPE, [6])" in pushed or "In(TYPE" in pushed


@pytest.mark.parametrize(
    "build",
    [
        lambda t: fine_report_document(t),
        lambda t: master_report_document(t, {"TYPE": {"$in": [6]}}),
        lambda t: fine_counts(t),
        lambda t: transaction_type_distribution(t),
    ],
)
def test_every_shuffle_is_pre_aggregated(table, build):
    assert exchanges_after_partial_aggregates(build(table))


def test_partial_aggregate_before_each_shuffle(table):
    text = plan_text(master_report(table))
    assert exchange_count(master_report(table)) == 2
    assert "SortMergeJoin" not in text and "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_type_distribution_without_kinds_reads_nothing(table):
    assert scan_count(transaction_type_distribution(table, {"SECTOR_NAME": "North"})) == 0


@pytest.mark.parametrize("build", [fine_report_rows, master_report_rows])
def test_report_rows_hold_no_list_and_scan_once(table, build):
    df = build(table)
    assert scan_count(df) == 1 and _read_columns(df) <= REPORT_READ
    assert "collect_list" not in plan_text(df) and "SinglePartition" not in plan_text(df)


def test_shared_dir_sets_and_invents_nothing(spark):
    from curbwatch.session import shared_dir

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        def __init__(self, base):
            self.conf = {"spark.checkpoint.dir": base}

    with pytest.raises(RuntimeError):
        shared_dir(Session(None))
    with pytest.raises(RuntimeError):
        shared_dir(Session("file:///tmp/x"))
    assert shared_dir(Session("hdfs://n/x"), "a", unique=False) == "hdfs://n/x/curbwatch/a"
