"""Session settings and the shared folder for materialised intermediate tables."""
from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def build_session(master: str = "local[8]", app: str = "recoup", shuffle: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a local master may fall back to a fresh temporary folder: on a cluster
    a machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="recoup-")
        spark.sparkContext.setCheckpointDir(_LOCAL_DIRS[app])
    return _LOCAL_DIRS[app]


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage of iterative work without relying on executor-local state.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), spark.sparkContext.applicationId,
                        f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go now.

    Spark deletes them when the driver collects its garbage, and a driver with little to do may not
    do so before the query ends; the disk would then hold the shuffles of all steps at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(scan: DataFrame) -> DataFrame:
    """Give a plain file scan at least one task per core.

    A table in one small row group is read by one task, and so would be all that is computed
    on it; a large table already has more splits than cores and is left alone, and so is a frame
    that comes from a shuffle (to ask for its partitions would run the shuffle).
    """
    if "Exchange" in scan._jdf.queryExecution().executedPlan().toString():
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
