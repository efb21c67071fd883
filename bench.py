"""Bench the headline reports on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec},
"sf", ...}. Each query is timed end to end (plan + run + collect of its
small result); all queries are warmed up first and then timed in
round-robin rounds; the reported time is the median of the rounds. ``value`` is the sum of the medians of the headline queries.

The detections collection is derived from ``events`` once, stored as
parquet in the shared folder and registered with the declared 40-column
schema (as a service registers its stored collection); every report then
scans that collection. For context, "derived_on_the_fly" times the two
documents over rows that are derived anew from ``events`` on each call.

For context it also times the same reports computed the way the original
service does it, one Spark action per metric ("per_metric"), and the
streaming ingest of one device message per event ("streaming": seconds and
messages per second for a full availableNow run on a fresh checkpoint);
neither is part of ``value``.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from curbwatch.operators import (  # noqa: E402
    drop_reason_distribution,
    fine_counts,
    fine_report_document,
    manual_review_count,
    master_report_document,
    sector_counts,
    sector_fine_distribution,
    sectors_count,
    transaction_count,
    transaction_type_distribution,
)
from curbwatch.schema import DETECTIONS_SCHEMA  # noqa: E402
from curbwatch.session import local_session, shared_dir  # noqa: E402
from curbwatch.sources import CollectionRegistry, load_detections, payloads_from_events  # noqa: E402
from curbwatch.streaming import BatchSink, read_messages, start_ingest  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARMUPS = int(os.environ.get("BENCH_WARMUPS", "3"))
RUNS = int(os.environ.get("BENCH_RUNS", "7"))

FILTERED = {"SECTOR_NAME": "SECTOR_3", "TYPE": {"$in": [1, 5, 6]}}

# min and max of the timed rounds, per query
RANGES: dict = {}


def _time(fn) -> float:
    for _ in range(WARMUPS):
        fn()
    samples = []
    for _ in range(RUNS):
        t0 = time.perf_counter()
        fn()
        samples.append(time.perf_counter() - t0)
    return round(statistics.median(samples), 4)


def _time_interleaved(fns: dict) -> dict:
    """Warm every query up first, then time them in round-robin rounds, so
    JVM warm-up and machine noise fall on all queries alike."""
    for _ in range(WARMUPS):
        for fn in fns.values():
            fn()
    samples: dict = {name: [] for name in fns}
    for _ in range(RUNS):
        for name, fn in fns.items():
            t0 = time.perf_counter()
            fn()
            samples[name].append(time.perf_counter() - t0)
    RANGES.update({name: [round(min(v), 4), round(max(v), 4)] for name, v in samples.items()})
    return {name: round(statistics.median(v), 4) for name, v in samples.items()}


def main() -> None:
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", CPUS if CPUS.isdigit() else "8"))
    checkpoints = tempfile.mkdtemp(prefix="curbwatch-bench-")
    spark = local_session(CPUS, shuffle_partitions=partitions, app="curbwatch-bench", checkpoint_dir=checkpoints)
    if "BENCH_AQE" in os.environ:
        spark.conf.set("spark.sql.adaptive.enabled", os.environ["BENCH_AQE"])

    stored = shared_dir(spark, "bench_collection")
    load_detections(spark, SF_DIR).write.parquet(stored)
    registry = CollectionRegistry(spark, format="parquet")
    registry.add("DETECTIONS", DETECTIONS_SCHEMA, path=stored)

    def det():
        return registry.get("DETECTIONS")

    headline = {
        "fine_report": lambda: fine_report_document(det()).collect(),
        "master_report": lambda: master_report_document(det()).collect(),
        "master_report_filtered": lambda: master_report_document(det(), FILTERED).collect(),
        "fine_counts": lambda: fine_counts(det()).collect(),
        "sector_counts": lambda: sector_counts(det()).collect(),
        "sector_fine_distribution": lambda: sector_fine_distribution(det()).collect(),
        "drop_reason_distribution": lambda: drop_reason_distribution(det()).collect(),
    }

    def fine_per_metric():
        df = det()
        for code in (88, 1, 2, 5):
            df.filter(df.FINE_TYPE == code).count()
        df.count()
        sector_counts(df).collect()

    def master_per_metric():
        df = det()
        for fn in (transaction_count, sectors_count, manual_review_count):
            fn(df).collect()
        for fn in (sector_fine_distribution, transaction_type_distribution, drop_reason_distribution):
            fn(df).collect()

    timed = _time_interleaved(
        {
            **headline,
            "per_metric_fine_report": fine_per_metric,
            "per_metric_master_report": master_per_metric,
            "derived_fine_report": lambda: fine_report_document(load_detections(spark, SF_DIR)).collect(),
            "derived_master_report": lambda: master_report_document(load_detections(spark, SF_DIR)).collect(),
        }
    )
    queries = {name: timed[name] for name in headline}
    per_metric = {"fine_report": timed["per_metric_fine_report"], "master_report": timed["per_metric_master_report"]}
    derived = {"fine_report": timed["derived_fine_report"], "master_report": timed["derived_master_report"]}

    root = shared_dir(spark, "bench_ingest")
    payloads = payloads_from_events(spark.read.parquet(f"{SF_DIR}/events.parquet"))
    payloads.write.text(f"{root}/inbox")
    messages = spark.read.text(f"{root}/inbox").count()
    runs = iter(range(1000))

    def ingest():
        run = next(runs)
        query = start_ingest(
            read_messages(spark, "text", f"{root}/inbox"),
            BatchSink("parquet", f"{root}/sink{run}"),
            f"{root}/checkpoint{run}",
            trigger={"availableNow": True},
        )
        query.awaitTermination()

    ingest_sec = _time(ingest)
    streaming = {"ingest_sec": ingest_sec, "messages": messages, "messages_per_sec": round(messages / ingest_sec)}
    sf_match = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "report_latency_sum",
                "value": round(sum(queries.values()), 4),
                "unit": "sec",
                "queries": queries,
                "ranges": {name: RANGES[name] for name in queries},
                "per_metric": per_metric,
                "derived_on_the_fly": derived,
                "streaming": streaming,
                "sf": float(sf_match.group(1)) if sf_match else SF_DIR,
                "cpus": CPUS,
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
