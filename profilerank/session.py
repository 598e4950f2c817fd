"""Session defaults and the place for files that a job writes for itself."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", memory: str = "8g", name: str = "profilerank") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
            .config("spark.driver.memory", memory)
            # Scoring costs milliseconds per kilobyte; small partitions are worth a task.
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
            .config("spark.sql.session.timeZone", "UTC")
            .getOrCreate())


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder.

    Every executor must see what another one wrote, so the folder is taken
    from ``spark.checkpoint.dir``.  Only where that is unset and the master is
    local, as in tests, a folder of this machine is used; it goes with the process.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if shared:
        return f"{shared.rstrip('/')}/profilerank-{name}-{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all machines of {master} share")
    folder = tempfile.mkdtemp(prefix=f"run-{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a scratch folder and read back: computed once, and safe from lost executors.

    The shuffle files behind them are of no use any more and go when the write is done, so that they
    do not lie beside those of the next step.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
