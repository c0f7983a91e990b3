"""Session helpers: defaults for local runs, and the shared checkpoint folder."""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

_local_dirs: dict[str, str] = {}


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "barflow") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BARFLOW_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where it is unset, a local master (tests, bench: driver and tasks
    are one process) gets a fresh folder per application; any other master raises, since executors don't share local folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[sc.applicationId]


def cut_lineage(df):
    """Reliable checkpoint in the shared folder (survives the loss of executors)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
