import pytest
from pyspark.sql import functions as F

from curbwatch.operators import fine_counts_by, fine_report_rows, fine_rows_from, master_counts_by, master_report_rows, master_rows_from
from curbwatch.schema import DETECTIONS_SCHEMA
from curbwatch.session import shared_dir
from curbwatch.sources import CollectionRegistry, load_detections
from curbwatch.sources.shared_files import SharedFiles
from curbwatch.streaming import BatchSink, IncrementalReport, master_report_counts

from .conftest import SF001
from .fixtures import edge_detections

FILTERS = [None, {"TYPE": {"$in": [1, 6]}}, {"PLATE_SOURCE": "AUTO"}, {"TYPE": 6, "SECTOR_NAME": "SECTOR_3"}]


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert got.dtypes == want.dtypes


@pytest.mark.parametrize("filters", FILTERS)
def test_counts_of_parts_make_the_report_of_the_whole(spark, filters):
    rows = load_detections(spark, SF001).withColumn("part", F.col("ID").cast("int") % 7)
    same(fine_rows_from(fine_counts_by(rows, ["part"])), fine_report_rows(rows))
    same(master_rows_from(master_counts_by(rows, ["part"], filters), filters), master_report_rows(rows, filters))
    none = rows.where("false")
    same(fine_rows_from(fine_counts_by(none, ["part"])), fine_report_rows(none))
    same(master_rows_from(master_counts_by(none, ["part"], filters), filters), master_report_rows(none, filters))


class Watched(IncrementalReport):
    """Remembers which files each refresh read."""

    def new_rows(self, roots, there, known):
        rows = super().new_rows(roots, there, known)
        self.read = set() if rows is None else {f.rsplit("/", 2)[-2] for f in rows.inputFiles()}
        return rows


def test_inserts_updates_and_deletes(spark):
    root = shared_dir(spark, "test_changes")
    path, files = f"{root}/DETECTIONS", SharedFiles(spark)
    rows = load_detections(spark, SF001)

    def put(part, df):
        df.coalesce(2).write.mode("overwrite").parquet(f"{path}/p={part}")

    def now():
        return spark.read.schema(DETECTIONS_SCHEMA).parquet(path)

    reports = [
        (Watched(spark, lambda: [path], DETECTIONS_SCHEMA, f"{root}/fine"), fine_report_rows),
        (Watched(spark, lambda: [path], DETECTIONS_SCHEMA, f"{root}/master", master_report_counts(FILTERS[1])),
         lambda df: master_report_rows(df, FILTERS[1])),
    ]

    def check(read):
        for report, whole in reports:
            same(report.refresh(), whole(now()))
            assert report.read == read

    parts = [rows.where(F.col("ID").cast("int") % 4 == i) for i in range(4)]
    put(0, parts[0]), put(1, parts[1])
    check({"p=0", "p=1"})
    check(set())  # nothing changed: nothing is read
    put(2, parts[2])
    check({"p=2"})  # insert
    put(1, parts[1].withColumn("FINE_TYPE", F.lit(88)).where("TYPE <> 5"))
    check({"p=1"})  # update: one folder rewritten
    files.delete(f"{path}/p=0")
    check(set())  # delete
    put(0, parts[3]), put(2, parts[2].limit(0)), put(3, edge_detections(spark))
    check({"p=0", "p=2", "p=3"})
    files.delete(f"{path}/p=0"), files.delete(f"{path}/p=1"), files.delete(f"{path}/p=2")
    check(set())


def test_counts_are_merged_and_old_state_goes(spark, monkeypatch):
    import curbwatch.streaming.incremental as module

    monkeypatch.setattr(module, "MERGE_FROM", 3)
    root = shared_dir(spark, "test_merge")
    report = IncrementalReport(spark, lambda: [f"{root}/c"], DETECTIONS_SCHEMA, f"{root}/state")
    for i in range(6):
        edge_detections(spark).write.mode("append").parquet(f"{root}/c")
        same(report.refresh(), fine_report_rows(spark.read.schema(DETECTIONS_SCHEMA).parquet(f"{root}/c")))
    names = SharedFiles(spark).names(f"{root}/state")
    assert len([n for n in names if n.startswith("listing-")]) <= 3
    assert len([n for n in names if n.startswith("counts-")]) <= 6
    same(IncrementalReport(spark, lambda: [], DETECTIONS_SCHEMA, f"{root}/state").rows(), report.rows())


def test_a_file_rewritten_while_it_is_read_is_read_again(spark):
    root = shared_dir(spark, "test_moving")
    rows = edge_detections(spark)
    rows.write.parquet(f"{root}/c")
    changed = []

    class Moving(IncrementalReport):
        def new_rows(self, roots, there, known):
            if not changed:  # after the listing, before the read
                changed.append(rows.limit(5).write.mode("overwrite").parquet(f"{root}/c"))
            return super().new_rows(roots, there, known)

    report = Moving(spark, lambda: [f"{root}/c"], DETECTIONS_SCHEMA, f"{root}/state")
    same(report.refresh(), fine_report_rows(spark.read.schema(DETECTIONS_SCHEMA).parquet(f"{root}/c")))


def test_committed_batches(spark):
    path = shared_dir(spark, "test_incremental_batches")
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "q")
    try:
        registry, sink = CollectionRegistry(spark), BatchSink("parquet", path)
        registry.add("LIVE", DETECTIONS_SCHEMA, path=path, batches=True)
        report = Watched(spark, lambda: registry.roots("LIVE"), DETECTIONS_SCHEMA, f"{path}-state")
        assert {r["value"] for r in report.refresh().collect()} == {0}
        for i in range(3):
            sink(edge_detections(spark), i)
            same(report.refresh(), fine_report_rows(registry.get("LIVE")))
            assert report.read == {f"batch_id={i}"}
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
