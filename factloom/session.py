"""Session construction and the few settings every plan of the library relies on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows hold whole documents, so Arrow batches are bounded by bytes well below Spark's default.
BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
ROOT = str(Path(__file__).resolve().parent.parent)


def build(master: str = "local[8]", app: str = "factloom", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer switched on."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FACTLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return attach(builder.getOrCreate())


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if the driver started elsewhere."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if spark.conf.get(BATCH_BYTES, None) in (None, BATCH_DEFAULT):
        spark.conf.set(BATCH_BYTES, "8m")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines share, as spark.checkpoint.dir names it. A temporary one where
    none is named and all runs on this machine; on a cluster it must be named."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factloom-")
        context.setCheckpointDir(root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return root.rstrip("/")
