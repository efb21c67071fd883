"""Session helpers: a local session for tests and benches, and the shared folder.

Library functions never build or configure a session themselves; the caller
owns it. ``local_session`` exists for tests, the bench and examples.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Re-plan the small shuffles behind partial aggregates at run time; UTC keeps
# timestamps comparable with other engines.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "curbwatch", checkpoint_dir: str | None = None
) -> SparkSession:
    """A local-mode session for tests and benches (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CURBWATCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A folder under the cluster's shared checkpoint folder:
    ``spark.checkpoint.dir``, or the context's checkpoint dir.

    Sets nothing and invents nothing: an unset folder is an error, and so is a
    ``file:`` folder on a cluster, which its machines do not share. Checkpoint
    folders are kept as given, scheme included.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if base.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{base} is a local folder of each machine; set spark.checkpoint.dir to a shared one")
    path = "/".join([base.rstrip("/"), "curbwatch", *parts])
    if unique:
        path = f"{path}/{uuid.uuid4().hex}"
    return path
