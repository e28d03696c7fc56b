"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state on disk: a large key set must not have to fit on the executors' heaps.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


SHUFFLE_PART_BYTES = 200 * 1024 * 1024


def shuffle_partitions(input_bytes: int, least: int = 200) -> int:
    """Partitions that hold about 200 MB each if all input were shuffled; AQE merges what is too
    small, but never splits a partition that is too large for reasons other than join skew."""
    return max(least, -(-input_bytes // SHUFFLE_PART_BYTES))


def build_session(master: str | None = None, app: str = "borgata", input_bytes: int | None = None,
                  **extra: str) -> SparkSession:
    """A session with AQE on.  ``extra`` keys use ``__`` for dots; ``input_bytes`` sizes shuffles."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if input_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes)))
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to the machine's own
    temporary folder: on a cluster no executor could see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = os.path.join(tempfile.gettempdir(), "borgata")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
