import json

import pytest

from curbwatch.__main__ import main
from curbwatch.session import shared_dir
from curbwatch.streaming import latest_report

from .fixtures import edge_detections
from .test_streaming import _msg, _write_lines


def test_report_command(spark, capsys):
    path = shared_dir(spark, "cli_collection")
    edge_detections(spark).write.parquet(path)
    assert main(["report", "fine", "--path", path], spark=spark) == 0
    doc = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert doc["fineCounts"]["toratalViolationCount"] == {"value": 12, "id": 0}
    assert main(["report", "master", "--path", path, "--filter", '{"TYPE": {"$in": [6]}}'], spark=spark) == 0
    doc = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert doc["transactionCount"] == 2 and doc["finesCount"] == 5 and doc["droppedCount"] == 0


def test_ingest_command(spark):
    root = shared_dir(spark, "cli_ingest")
    _write_lines(f"{root}/in", [_msg(i) for i in range(15)])
    argv = [
        "ingest", "--source-format", "text", "--source-path", f"{root}/in",
        "--sink-path", f"{root}/out", "--checkpoint", f"{root}/ckpt", "--available-now",
    ]
    assert main(argv, spark=spark) == 0
    assert main(argv, spark=spark) == 0
    assert spark.read.parquet(f"{root}/out").count() == 15


def test_report_rows_command(spark):
    root = shared_dir(spark, "cli_rows")
    edge_detections(spark).write.parquet(f"{root}/c")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert main(["report", "master", "--path", f"{root}/c", "--output-path", f"{root}/out"], spark=spark) == 0
    rows = {(r["section"], r["name"]): r["value"] for r in spark.read.parquet(f"{root}/out").collect()}
    assert rows["transactionCount", None] == 12 and rows["transactionTypesDistribution", "fine"] == 5
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_quarantine_command(spark):
    root = shared_dir(spark, "cli_quarantine")
    _write_lines(f"{root}/in", [_msg(1), "{bad"])
    argv = [
        "ingest", "--source-format", "text", "--source-path", f"{root}/in", "--sink-path", f"{root}/out",
        "--checkpoint", f"{root}/ckpt", "--available-now", "--on-malformed", "quarantine",
        "--quarantine-path", f"{root}/bad",
    ]
    assert main(argv, spark=spark) == 0
    assert spark.read.parquet(f"{root}/out").count() == 1
    assert [r["value"] for r in spark.read.json(f"{root}/bad").collect()] == ["{bad"]
    with pytest.raises(SystemExit):
        main(argv[:-2], spark=spark)


def test_message_id_command_needs_kafka_columns(spark):
    root = shared_dir(spark, "cli_message_id")
    _write_lines(f"{root}/in", [_msg(1)])
    argv = [
        "ingest", "--source-format", "text", "--source-path", f"{root}/in", "--sink-path", f"{root}/out",
        "--checkpoint", f"{root}/ckpt", "--available-now", "--message-id",
    ]
    with pytest.raises(ValueError, match="Kafka columns"):
        main(argv, spark=spark)


def test_watch_command(spark):
    root = shared_dir(spark, "cli_watch")
    edge_detections(spark).write.parquet(f"{root}/c")
    _write_lines(f"{root}/changes", ['{"operationType": "insert"}'])
    argv = [
        "watch", "fine", "--path", f"{root}/c", "--changes-path", f"{root}/changes", "--report-path", f"{root}/reports",
        "--checkpoint", f"{root}/ckpt", "--available-now",
    ]
    assert main(argv, spark=spark) == 0
    rows = {(r["section"], r["name"]): r["value"] for r in latest_report(spark, f"{root}/reports").collect()}
    assert rows["fineCounts", "toratalViolationCount"] == 12


def test_watch_command_from_changed_files(spark):
    root = shared_dir(spark, "cli_watch_state")
    for kind in ("fine", "master"):
        argv = [
            "watch", kind, "--path", f"{root}/{kind}", "--changes-path", f"{root}/changes", "--report-path", f"{root}/reports-{kind}",
            "--checkpoint", f"{root}/ckpt-{kind}", "--state-path", f"{root}/state-{kind}", "--available-now",
        ]
        for rows in (12, 24):
            edge_detections(spark).write.mode("append").parquet(f"{root}/{kind}")
            _write_lines(f"{root}/changes", ['{"operationType": "insert"}'])
            assert main(argv, spark=spark) == 0
            found = {(r["section"], r["name"]): r["value"] for r in latest_report(spark, f"{root}/reports-{kind}").collect()}
            key = ("fineCounts", "toratalViolationCount") if kind == "fine" else ("transactionCount", None)
            assert found[key] == rows
