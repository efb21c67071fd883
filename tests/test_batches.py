import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from curbwatch.operators import fine_report_rows, master_report_rows, section_rows
from curbwatch.schema import DETECTIONS_SCHEMA
from curbwatch.session import shared_dir
from curbwatch.sources import CollectionRegistry
from curbwatch.sources.shared_files import SharedFiles
from curbwatch.streaming import BatchList, BatchSink, sink_rows

from .fixtures import edge_detections

SCHEMA = StructType([StructField("imei", StringType()), StructField("status", IntegerType())])


@pytest.fixture
def in_query(spark):
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "query-1")
    yield
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)


def batch(spark, i, n=2):
    return spark.createDataFrame([(f"{i}-{k}", k) for k in range(n)], SCHEMA).coalesce(1)


def imeis(rows):
    return sorted(r["imei"] for r in rows.collect())


def test_a_half_written_batch_is_not_seen(spark, in_query):
    path = shared_dir(spark, "test_half")
    sink = BatchSink("parquet", path)
    sink(batch(spark, 0), 0)
    batch(spark, 1).write.parquet(f"{path}/query=query-1/batch_id=1")  # written, not entered: the job died here
    assert imeis(sink_rows(spark, path)) == ["0-0", "0-1"]
    sink(batch(spark, 1), 1)  # replayed
    assert imeis(sink_rows(spark, path)) == ["0-0", "0-1", "1-0", "1-1"]


def test_a_sink_without_a_list_is_read_as_it_is(spark):
    path = shared_dir(spark, "test_old_sink")
    batch(spark, 0).write.parquet(f"{path}/query=a/batch_id=0")
    assert imeis(sink_rows(spark, path)) == ["0-0", "0-1"]


def test_compaction_keeps_rows_and_replay_adds_nothing(spark, in_query):
    path = shared_dir(spark, "test_compact")
    sink, batches = BatchSink("parquet", path), BatchList(spark, path)
    for i in range(13):
        sink(batch(spark, i), i)
    before = batches.snapshot()
    after = batches.compact(SCHEMA, fan_in=4)
    want = sorted(f"{i}-{k}" for i in range(13) for k in range(2))
    assert len(before.tiers) == 13 and len(after.tiers) == 1
    assert imeis(after.rows(spark, SCHEMA)) == want
    sink(batch(spark, 5), 5)  # replay of a compacted batch
    sink(batch(spark, 13), 13)
    assert imeis(sink_rows(spark, path)) == sorted([*want, "13-0", "13-1"])
    assert imeis(before.rows(spark, SCHEMA)) == want  # readers of the list before can go on
    for i in range(14, 30):
        sink(batch(spark, i), i)
        batches.compact(SCHEMA, fan_in=4)
    want = sorted(f"{i}-{k}" for i in range(30) for k in range(2))
    assert imeis(sink_rows(spark, path, schema=SCHEMA)) == want
    assert len(batches.snapshot().tiers) < 10


def test_clean_removes_what_no_recent_state_needs(spark, in_query):
    path = shared_dir(spark, "test_clean")
    sink, batches, files = BatchSink("parquet", path), BatchList(spark, path), SharedFiles(spark)
    for i in range(9):
        sink(batch(spark, i), i)
        batches.compact(SCHEMA, fan_in=3)
    assert batches.clean() > 0
    assert imeis(sink_rows(spark, path)) == sorted(f"{i}-{k}" for i in range(9) for k in range(2))
    assert len([n for n in files.names(f"{path}/_batches") if n.startswith("state-")]) == 2
    sink(batch(spark, 0), 0)  # still known to be there
    assert sink_rows(spark, path).count() == 18


def test_of_two_compactions_one_counts(spark, in_query, monkeypatch):
    path = shared_dir(spark, "test_race")
    sink, batches = BatchSink("parquet", path), BatchList(spark, path)
    for i in range(4):
        sink(batch(spark, i), i)
    seen = batches.snapshot()
    batches.compact(SCHEMA, fan_in=2)
    late = BatchList(spark, path)
    real = late.snapshot
    monkeypatch.setattr(late, "snapshot", lambda: seen)  # as if it had begun before
    late.compact(SCHEMA, fan_in=2)
    monkeypatch.setattr(late, "snapshot", real)
    assert imeis(sink_rows(spark, path)) == sorted(f"{i}-{k}" for i in range(4) for k in range(2))
    assert len(SharedFiles(spark).names(f"{path}/_merged/tier=1")) == 1


def test_a_thousand_batches_are_a_few_files(spark):
    path = shared_dir(spark, "test_thousand")
    batches = BatchList(spark, path)
    spark.range(1000).select(F.col("id").cast("string").alias("imei"), F.lit(1).alias("status"), (F.col("id") % 1000).alias("batch_id")
                             ).write.partitionBy("batch_id").parquet(f"{path}/query=q")
    for i in range(10):
        batches.commit("q", i, f"query=q/batch_id={i}")
    folder = urllib.parse.urlparse(f"{path}/_batches").path
    for i in range(10, 1000):  # what commit() writes, without a thousand round trips
        with open(f"{folder}/entry-q-{i}.json", "w") as fh:
            json.dump({"query": "q", "batch": i, "folder": f"query=q/batch_id={i}"}, fh)
    after = batches.compact(SCHEMA, fan_in=10)
    rows = after.rows(spark, SCHEMA)
    assert rows.count() == 1000 and len(rows.inputFiles()) == 1
    assert batches.committed("q", 999) and not batches.committed("q", 1000)


def test_both_reports_of_one_get_agree_while_batches_arrive(spark):
    path = shared_dir(spark, "test_snapshot")
    registry = CollectionRegistry(spark)
    session = spark.newSession()
    edge, stop, errors = edge_detections(session), threading.Event(), []

    def feed():
        session.sparkContext.setLocalProperty("sql.streaming.queryId", "feed")
        sink = BatchSink("parquet", path)
        i = 0
        try:
            while not stop.is_set():
                sink(edge, i)
                i += 1
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    registry.add("LIVE", DETECTIONS_SCHEMA, path=path, batches=True)
    feeder = threading.Thread(target=feed)
    feeder.start()
    totals = []
    for _ in range(6):
        rows = registry.get("LIVE")
        fine = section_rows(fine_report_rows(rows), "fineCounts").where("name = 'toratalViolationCount'").first()["value"]
        master = section_rows(master_report_rows(rows), "transactionCount").first()["value"]
        totals.append((fine, master))
    stop.set()
    feeder.join()
    assert not errors
    assert all(fine == master and fine % 12 == 0 for fine, master in totals)
    assert totals[-1][0] > totals[0][0]


def test_empty_list(spark):
    path = shared_dir(spark, "test_none")
    assert BatchList(spark, path).snapshot().rows(spark, SCHEMA).collect() == []
    with pytest.raises(ValueError):
        CollectionRegistry(spark).add("X", DETECTIONS_SCHEMA, batches=True)


def test_entries_are_plain_text(spark, in_query):
    path = shared_dir(spark, "test_entry")
    BatchSink("parquet", path)(batch(spark, 0), 0)
    text = SharedFiles(spark).read(f"{path}/_batches/entry-query-1-0.json")
    assert json.loads(text) == {"query": "query-1", "batch": 0, "folder": "query=query-1/batch_id=0"}


# ---------------------------------------------------------------- connector sinks


class Died(Exception):
    pass


def connector(spark, root):
    return BatchSink("json", commit_log=f"{root}/log", options={"path": f"{root}/collection"})


def rows_of(spark, root):
    return [(r["imei"], r["status"]) for r in spark.read.schema(SCHEMA).json(f"{root}/collection").collect()]


@pytest.mark.parametrize("written", ["nothing", "half", "all"])
def test_a_batch_with_intent_but_no_commit_is_settled(spark, in_query, monkeypatch, written):
    import curbwatch.streaming.ingest as module

    root = shared_dir(spark, "test_intent")
    real = module.write_collection
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", None)], SCHEMA)

    def dying(df, *args, **kwargs):
        if written != "nothing":
            real(df if written == "all" else df.where("imei <> 'b'").limit(2), *args, **kwargs)
        raise Died

    monkeypatch.setattr(module, "write_collection", dying)
    with pytest.raises(Died):
        connector(spark, root)(rows, 0)
    monkeypatch.setattr(module, "write_collection", real)
    connector(spark, root)(rows, 0)  # restart
    want = sorted([("a", 1), ("a", 1), ("b", 2), ("c", None)], key=str)
    assert sorted(rows_of(spark, root), key=str) == want
    connector(spark, root)(rows, 0)
    connector(spark, root)(rows.limit(1), 1)
    assert len(rows_of(spark, root)) == 5
