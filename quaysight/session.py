"""Spark session defaults for the reports.

On a cluster the session is created by the platform; ``tune_session`` only
sets what the reports rely on (UTC clock, AQE) and leaves sizing knobs that the
cluster already chose alone.  ``build_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the reports need for correct and repeatable results, plus AQE so
# that join strategies and partition counts follow the actual data sizes.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Bytes of an Arrow batch that travels to a Python worker, unless the session
# names another size: a task holds several copies of a batch (Arrow vectors in
# the executor, the batch and its Python objects in the worker).
BATCH_CONF = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

# Bytes of the shuffled input of a task, unless the session names another size:
# compressed rows take up to 30 times as much in the sorts of a join.
TASK_CONF = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")


def tune_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the reports rely on to an existing session."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    for key, value in (BATCH_CONF, TASK_CONF):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster it is the shared folder named by ``spark.checkpoint.dir``;
    a missing setting is an error there, since a driver-local folder is not
    visible to executors.  Only a ``local[...]`` session (tests, local runs)
    gets a temporary folder of its own when none is configured.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    try:
        sc = spark.sparkContext
    except Exception:   # a Spark Connect session: the setting is the only source
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster") from None
    configured = sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                           "(the reports write reused intermediates there)")
    local = tempfile.mkdtemp(prefix="quaysight-ckpt-")
    sc.setCheckpointDir(local)
    return local


def build_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "quaysight") -> SparkSession:
    """Local session for tests and benchmarks (UI off, loopback driver)."""
    parts = shuffle_partitions or (os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("QUAYSIGHT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Column call-site capture for error messages costs ~5 driver<->JVM
        # round trips per column function; reports build hundreds of them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
