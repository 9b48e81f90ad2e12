"""Spark session and shared-storage helpers.

On a cluster the session is created by the platform; ``get_session`` is for
tests, the bench and local runs. Lineage is cut with reliable checkpoints in
the folder the cluster names in ``spark.checkpoint.dir``; a scratch folder is
only chosen when that setting is absent (local runs and tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _driver_memory() -> str:
    """About 60 % of physical memory (local mode runs everything in the driver), <= 16g."""
    if os.environ.get("RISKLOOM_DRIVER_MEMORY"):
        return os.environ["RISKLOOM_DRIVER_MEMORY"]
    try:
        with open("/proc/meminfo") as fh:
            kb = next(int(line.split()[1]) for line in fh if line.startswith("MemTotal"))
        return f"{max(1, min(16, int(kb / 1024 / 1024 * 0.6)))}g"
    except (OSError, StopIteration, ValueError):
        return "4g"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "riskloom") -> SparkSession:
    cores = os.environ.get("BENCH_CPUS")
    master = master or (f"local[{cores}]" if cores else "local[8]")
    parts = shuffle_partitions or int(cores or 8)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", _driver_memory())
        # drop checkpoint files once their DataFrames are garbage collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        # Only local runs and tests may do without a shared folder.
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="riskloom-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for sinks and stream state)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_path`` named."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: survives executor loss, cuts lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
