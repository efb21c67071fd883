import json

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, TimestampType

from curbwatch.operators import fine_report_document, master_report_document
from curbwatch.schema import DETECTIONS_SCHEMA, STREAM_SCHEMA
from curbwatch.sources import conform


def test_detections_schema():
    assert len(DETECTIONS_SCHEMA) == 40
    assert all(f.nullable for f in DETECTIONS_SCHEMA)
    kinds = [type(f.dataType) for f in DETECTIONS_SCHEMA]
    assert kinds.count(StringType) == 24 and kinds.count(IntegerType) == 11
    assert kinds.count(DoubleType) == 1 and kinds.count(LongType) == 1 and kinds.count(TimestampType) == 2
    assert DETECTIONS_SCHEMA["COORDINATES"].dataType == ArrayType(DoubleType())
    assert [f.name for f in STREAM_SCHEMA] == ["imei", "time", "status", "assetId", "crewId", "timestamp"]


def test_conform_adds_typed_nulls(spark):
    df = conform(spark.createDataFrame([("7", 1)], "id string, type int"))
    assert df.schema == DETECTIONS_SCHEMA or [f.name for f in df.schema] == DETECTIONS_SCHEMA.names
    row = df.collect()[0]
    assert row["ID"] == "7" and row["TYPE"] == 1 and row["SECTOR_NAME"] is None


def test_fine_report_document(edge):
    doc = json.loads(fine_report_document(edge).collect()[0]["document"])
    assert list(doc) == ["fineCounts", "sectors"]
    assert list(doc["fineCounts"]) == [
        "toratalViolationCount",
        "illegalParkingViolationCount",
        "notPaidViolationCount",
        "notAuthorizedViolationCount",
        "overStayViolationCount",
    ]
    assert doc["fineCounts"]["toratalViolationCount"] == {"value": 12, "id": 0}
    assert doc["fineCounts"]["illegalParkingViolationCount"] == {"value": 2, "id": 88}
    assert doc["sectors"] == [
        {"name": "East", "value": 2},
        {"name": "North", "value": 4},
        {"name": "South", "value": 2},
        {"name": "Unknown", "value": 1},
        {"name": "Unknown", "value": 1},
        {"name": "Unknown", "value": 2},
    ]


def test_master_report_document(edge):
    text = master_report_document(edge).collect()[0]["document"]
    doc = json.loads(text)
    assert list(doc) == [
        "transactionCount",
        "sectors",
        "sectorsFineDistribution",
        "transactionTypesDistribution",
        "droppedTransactionDistribution",
        "manualReviewedTransactionCount",
        "finesCount",
        "droppedCount",
    ]
    assert doc["sectorsFineDistribution"] == [
        {"name": None, "value": 1},
        {"name": "", "value": 1},
        {"name": "North", "value": 2},
        {"name": "Unknown", "value": 1},
    ]
    assert doc["transactionTypesDistribution"] == [
        {"name": "PaidTransaction", "value": 2},
        {"name": "dropped", "value": 3},
        {"name": "fine", "value": 5},
    ]
    assert doc["droppedTransactionDistribution"] == [{"name": None, "value": 1}, {"name": 3, "value": 2}]
    assert (doc["transactionCount"], doc["sectors"], doc["manualReviewedTransactionCount"]) == (12, 4, 4)
    assert (doc["finesCount"], doc["droppedCount"]) == (5, 3)
    assert master_report_document(edge).collect()[0]["document"] == text


def test_master_report_document_empty_kinds(edge):
    doc = json.loads(master_report_document(edge, {"SECTOR_NAME": "North"}).collect()[0]["document"])
    assert doc["transactionTypesDistribution"] == [] and doc["finesCount"] == 0


def test_fine_report_response_validates_and_ignores_parameters(edge):
    import pytest

    from curbwatch.operators import fine_report_response

    plain = fine_report_document(edge).collect()[0]["document"]
    narrowed = fine_report_response(edge, sector_name="North", start_date=0, end_date=5, fine_type=88)
    assert narrowed.collect()[0]["document"] == plain
    with pytest.raises(ValueError):
        fine_report_response(edge, sector_name="No")


def _joined(spark, fragments, name):
    import glob

    from curbwatch.operators import save_document, saved_document
    from curbwatch.session import shared_dir

    path = shared_dir(spark, name)
    save_document(fragments, path)
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))
    assert saved_document(spark, path).first()["document"] == text
    return text, len(glob.glob(f"{path}/part-*"))


def test_saved_documents_are_byte_equal(spark, edge):
    from curbwatch.operators import fine_document_fragments, fine_report_rows, master_document_fragments, master_report_rows

    filters = [None, {"TYPE": {"$in": [6]}}, {"TYPE": {"$in": []}}, {"SECTOR_NAME": "North"}, {"TYPE": 5}]
    odd = edge.selectExpr("* EXCEPT (SECTOR_NAME)", "concat(SECTOR_NAME, '}\"\n,{') AS SECTOR_NAME")
    for source in (edge, odd, edge.where("false")):
        text, _ = _joined(spark, fine_document_fragments(fine_report_rows(source)), "test_saved_fine")
        assert text == fine_report_document(source).first()["document"]
        for f in filters:
            text, _ = _joined(spark, master_document_fragments(master_report_rows(source, f), f), "test_saved_master")
            assert text == master_report_document(source, f).first()["document"]


def test_a_long_document_is_many_files(spark):
    from curbwatch.operators import fine_document_fragments, fine_report_rows
    from curbwatch.schema import DETECTIONS_SCHEMA
    from curbwatch.sources.detections import conform

    rows = spark.range(0, 6000, 1, 4).selectExpr("concat('S', id % 2000) AS SECTOR_NAME", "CAST(id % 2 AS INT) AS FINE_TYPE")
    source = conform(rows, DETECTIONS_SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text, files = _joined(spark, fine_document_fragments(fine_report_rows(source)), "test_long")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert files > 2
    assert text == fine_report_document(source).first()["document"]
