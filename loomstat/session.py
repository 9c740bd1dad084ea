"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomstat")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _temporary() -> str:
    """A folder that goes when the process does."""
    folder = tempfile.mkdtemp(prefix="loomstat-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Clusters name it in ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on one machine, a temporary folder is made and removed at the end of the process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = spark.sparkContext.getCheckpointDir() or _temporary()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared
