import json
import os
import uuid

import pytest

from curbwatch.schema import STREAM_SCHEMA
from curbwatch.session import shared_dir
from curbwatch.streaming import BatchSink, decode_messages, read_messages, sink_rows, start_ingest

AVAILABLE_NOW = {"availableNow": True}

# FIXTURES.md F3: payload -> (imei, status, crewId)
DECODE_TABLE = [
    ('{"imei":"1","time":"t","status":4,"assetId":"a","crewId":"c","timestamp":"x"}', ("1", 4, "c")),
    ("{bad", (None, None, None)),
    ("", (None, None, None)),
    (None, (None, None, None)),
    ('{"imei":"2","status":"4"}', ("2", None, None)),
    ('{"imei":"3","status":4.5}', ("3", None, None)),
    ('{"imei":"4","status":"zz","crewId":"k"}', ("4", None, "k")),
    ('{"IMEI":"5"}', (None, None, None)),
    ('{"imei":6,"extra":1}', ("6", None, None)),
    ("[]", (None, None, None)),
    ('[{"imei":"7"},{"imei":"8"}]', (None, None, None)),
    ('{"imei":{"a":1}}', ('{"a":1}', None, None)),
]


def _payloads(spark):
    return spark.createDataFrame([(v,) for v, _ in DECODE_TABLE], "value string")


def test_decode_table(spark):
    out = decode_messages(_payloads(spark)).collect()
    assert [f.name for f in decode_messages(_payloads(spark)).schema.fields] == [f.name for f in STREAM_SCHEMA]
    assert [(r["imei"], r["status"], r["crewId"]) for r in out] == [e for _, e in DECODE_TABLE]


def test_decode_binary_value(spark):
    df = spark.createDataFrame([(bytearray(b'{"imei":"9","status":1}'),)], "value binary")
    row = decode_messages(df).collect()[0]
    assert (row["imei"], row["status"]) == ("9", 1)


def test_decode_drop_and_flag(spark):
    kept = decode_messages(_payloads(spark), on_malformed="drop").collect()
    assert sorted(r["imei"] or "-" for r in kept) == ["-", "1", "6", '{"a":1}']
    flagged = decode_messages(_payloads(spark), on_malformed="flag").collect()
    assert len(flagged) == len(DECODE_TABLE)
    assert sum(r["_malformed"] for r in flagged) == len(DECODE_TABLE) - 4
    with pytest.raises(ValueError):
        decode_messages(_payloads(spark), on_malformed="skip")


def _write_lines(folder, lines):
    os.makedirs(folder, exist_ok=True)
    name = os.path.join(folder, f"part-{uuid.uuid4().hex}.txt")
    with open(name + ".tmp", "w") as fh:
        fh.write("\n".join(lines) + "\n")
    os.replace(name + ".tmp", name)


def _msg(i):
    return json.dumps({"imei": str(i), "time": "t", "status": i % 10, "assetId": "a", "crewId": "c", "timestamp": "x"})


def _run(spark, inbox, sink_dir, checkpoint, **kwargs):
    query = start_ingest(read_messages(spark, "text", inbox), BatchSink("parquet", sink_dir), checkpoint,
                         trigger=AVAILABLE_NOW, **kwargs)
    query.awaitTermination()


def test_restart_adds_nothing_and_new_file_once(spark):
    root = shared_dir(spark, "test_ingest")
    inbox, sink_dir, checkpoint = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    _write_lines(inbox, [_msg(i) for i in range(50)])
    _run(spark, inbox, sink_dir, checkpoint)
    assert spark.read.parquet(sink_dir).count() == 50
    _run(spark, inbox, sink_dir, checkpoint)
    assert spark.read.parquet(sink_dir).count() == 50
    _write_lines(inbox, [_msg(i) for i in range(50, 60)])
    _run(spark, inbox, sink_dir, checkpoint)
    out = spark.read.parquet(sink_dir)
    assert out.count() == 60
    assert sorted(int(r["imei"]) for r in out.collect()) == list(range(60))


def test_update_mode_same_rows(spark):
    root = shared_dir(spark, "test_update")
    inbox = f"{root}/in"
    _write_lines(inbox, [_msg(i) for i in range(20)])
    _run(spark, inbox, f"{root}/a", f"{root}/ca")
    _run(spark, inbox, f"{root}/u", f"{root}/cu", output_mode="update")
    a = sorted(tuple(r) for r in sink_rows(spark, f"{root}/a").collect())
    u = sorted(tuple(r) for r in sink_rows(spark, f"{root}/u").collect())
    assert a == u and len(a) == 20


@pytest.fixture
def in_query(spark):
    """As inside a streaming query's batch."""
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "query-1")
    yield
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)


def test_replayed_batch_is_not_appended_twice(spark, in_query):
    root = shared_dir(spark, "test_sink")
    sink = BatchSink("parquet", f"{root}/out")
    batch = spark.createDataFrame([("1", 1), ("2", 2)], "imei string, status int")
    sink(batch, 7)
    sink(batch, 7)
    sink(batch.limit(1), 8)
    assert spark.read.parquet(f"{root}/out").count() == 3


def test_quarantine(spark):
    root = shared_dir(spark, "test_quarantine")
    inbox = f"{root}/in"
    _write_lines(inbox, [_msg(1), "{bad", '{"imei":"2","status":"x"}', _msg(3)])
    query = start_ingest(
        read_messages(spark, "text", inbox), BatchSink("parquet", f"{root}/good"), f"{root}/ckpt",
        on_malformed="quarantine", quarantine=BatchSink("text", f"{root}/bad"), trigger=AVAILABLE_NOW,
    )
    query.awaitTermination()
    assert sorted(r["imei"] for r in spark.read.parquet(f"{root}/good").collect()) == ["1", "3"]
    assert sorted(r["value"] for r in spark.read.text(f"{root}/bad").collect()) == ['{"imei":"2","status":"x"}', "{bad"]


def test_checkpoint_required(spark):
    with pytest.raises(ValueError):
        start_ingest(read_messages(spark, "rate"), BatchSink("parquet", "/nowhere"), "")


def test_batch_replayed_after_crash_adds_no_duplicates(spark):
    """The sink writes a batch, then the job dies before the batch is
    committed; the restarted query replays that batch id and overwrites."""
    from pyspark.errors import StreamingQueryException

    root = shared_dir(spark, "test_crash")
    inbox, sink_dir, checkpoint = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    _write_lines(inbox, [_msg(i) for i in range(30)])
    sink = BatchSink("parquet", sink_dir)
    calls = []

    def crashing(batch, batch_id):
        sink(batch, batch_id)
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("lost after writing, before commit")

    query = start_ingest(read_messages(spark, "text", inbox), crashing, checkpoint, trigger=AVAILABLE_NOW)
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    assert spark.read.parquet(sink_dir).count() == 30  # written once, not committed
    _run(spark, inbox, sink_dir, checkpoint)  # restart: replays the same batch id
    assert spark.read.parquet(sink_dir).count() == 30
    assert sorted(int(r["imei"]) for r in spark.read.parquet(sink_dir).collect()) == list(range(30))


def test_message_id_from_kafka_coordinates(spark):
    rows = [(bytearray(_msg(i).encode()), "device-messages", i % 2, 100 + i) for i in range(4)]
    kafka_like = spark.createDataFrame(rows, "value binary, topic string, partition int, offset long")
    out = decode_messages(kafka_like, message_id=True)
    assert out.columns == [f.name for f in STREAM_SCHEMA] + ["message_id"]
    assert [r["message_id"] for r in out.collect()] == [f"device-messages/{i % 2}/{100 + i}" for i in range(4)]
    flagged = decode_messages(kafka_like, on_malformed="flag", message_id=True)
    assert "message_id" in flagged.columns
    with pytest.raises(ValueError):
        decode_messages(_payloads(spark), message_id=True)


def test_connector_sink_commit_log_skips_replayed_batch(spark, in_query):
    root = shared_dir(spark, "test_commit_log")
    # a sink addressed by options only (no path argument), like a connector
    sink = BatchSink("json", commit_log=f"{root}/log", options={"path": f"{root}/collection"})
    batch = spark.createDataFrame([("1", 1), ("2", 2)], "imei string, status int")
    sink(batch, 0)
    sink(batch, 0)  # replay of a committed batch: skipped
    sink(batch.limit(1), 1)
    out = spark.read.json(f"{root}/collection")
    assert out.count() == 3
    assert sorted(r["batch_id"] for r in out.collect()) == [0, 0, 1]


def test_a_second_checkpoint_neither_overwrites_nor_skips(spark):
    """Batch ids start at 0 for every checkpoint; both feeds' rows must be there."""
    root = shared_dir(spark, "test_two_checkpoints")
    _write_lines(f"{root}/in1", [_msg(i) for i in range(10)])
    _write_lines(f"{root}/in2", [_msg(i) for i in range(10, 25)])
    sinks = {
        "path": BatchSink("parquet", f"{root}/path"),
        "log": BatchSink("parquet", commit_log=f"{root}/log", options={"path": f"{root}/rows"}),
    }
    for kind, sink in sinks.items():
        for feed in ("in1", "in2", "in1"):
            messages = read_messages(spark, "text", f"{root}/{feed}")
            start_ingest(messages, sink, f"{root}/{kind}-{feed}", trigger=AVAILABLE_NOW).awaitTermination()
    for rows in (sink_rows(spark, f"{root}/path"), spark.read.parquet(f"{root}/rows")):
        assert sorted(int(r["imei"]) for r in rows.collect()) == list(range(25))


def test_sink_outside_a_query_is_an_error(spark):
    with pytest.raises(RuntimeError):
        BatchSink("parquet", "/nowhere")(spark.range(1), 0)


def test_quarantined_rows_keep_their_message_id(spark):
    from curbwatch.streaming.ingest import _quarantine_router

    rows = [(bytearray(x.encode()), "t", 0, i) for i, x in enumerate([_msg(1), "{bad"])]
    flagged = decode_messages(
        spark.createDataFrame(rows, "value binary, topic string, partition int, offset long"), on_malformed="flag", message_id=True
    )
    got = {}
    fields = [f.name for f in STREAM_SCHEMA] + ["message_id"]
    route = _quarantine_router(
        lambda b, i: got.update(good=b.collect()), lambda b, i: got.update(bad=b.collect()), fields
    )
    route(flagged, 0)
    assert [(r["value"], r["message_id"]) for r in got["bad"]] == [("{bad", "t/0/1")]
    assert [r["message_id"] for r in got["good"]] == ["t/0/0"]
