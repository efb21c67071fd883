"""Helpers shared by the corpus operators: tables, shared folders, batches of text."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHIPPED: set[str] = set()  # applications whose workers have this package


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` would. The zip
    file is sent by Spark, so it need not lie where executors can read."""
    context = spark.sparkContext
    if context.applicationId in SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    package = os.path.basename(top)
    path = os.path.join(tempfile.mkdtemp(), f"{package}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(package, os.path.relpath(full, top)))
    context.addPyFile(path)
    SHIPPED.add(context.applicationId)


WORKER_TABLES: dict[str, object] = {}  # what a Python worker keeps from task to task; one entry


def worker_table(name: str, make):
    """This worker's table of that name, made if need be; tables of other operators go."""
    if name not in WORKER_TABLES:
        WORKER_TABLES.clear()
        WORKER_TABLES[name] = make()
    return WORKER_TABLES[name]


def drop_worker_tables() -> None:
    """For operators that keep none: the memory is theirs."""
    WORKER_TABLES.clear()


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` (or the context's checkpoint
    folder), by the rule of ``session.shared_dir``. Where neither is set, a session in one
    process gets a temporary one; on a cluster it is an error, as a machine-local folder is
    not shared."""
    context = spark.sparkContext
    unset = not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir()
    if unset and (context.master == "local" or context.master.startswith("local[")):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return shared_dir(spark, "corpus")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage: what follows reads the committed files, so a lost
    executor never recomputes (or re-decides) what was written. The folder's
    owner is whoever owns ``spark.checkpoint.dir``. Shuffle files of finished
    steps go when the driver collects its garbage; that is asked for here, as
    steps follow each other faster than it would come to it by itself.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_folder(spark)
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def ascii_lower(column):
    """Lower-case A-Z only (``lower`` also maps other letters)."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def inline_rows(spark: SparkSession, json_rows: str, schema: str) -> DataFrame:
    """A small bounded table from JSON text, without Python objects or RDDs in the plan."""
    rows = F.explode(F.from_json(F.lit(json_rows), f"array<struct<{schema}>>")).alias("r")
    return spark.range(0, 1, 1, 1).select(rows).select("r.*")


def text_blocks(texts: Iterable, max_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) in runs of about ``max_bytes``;
    a longer text is a run of its own. Null is empty."""
    start, block, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if block and size + len(raw) > max_bytes:
            yield start, block
            start, block, size = i, [], 0
        block.append(raw)
        size += len(raw)
    if block:
        yield start, block
