"""Session helpers: a local session for tests/bench and lineage cutting.

Library code never creates a session; it works on whatever session owns
the DataFrames it is given.  ``local_session`` exists for tests, the bench
and examples only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tabsense") -> SparkSession:
    """A local[N] session configured the way the bench and tests expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABSENSE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def worker_path(spark: SparkSession) -> None:
    """Python workers inherit the folder of the package, in case the session was started elsewhere."""
    if ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        spark.sparkContext.setCheckpointDir(d)
        return d
    return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint dir; only when unset (tests, local
    runs) create a scratch one."""
    d = checkpoint_dir(spark)
    if d:
        return d
    d = tempfile.mkdtemp(prefix="tabsense-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage before a stage that several later jobs re-read: a reliable
    ``checkpoint()`` into the folder the cluster names."""
    require_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def require_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder, or an error: a machine-local one would lose data on a cluster.
    A session on one machine (``local[...]``) may use a scratch folder of its own."""
    d = checkpoint_dir(spark)
    if d:
        return d
    if spark.sparkContext.master.startswith("local["):
        return ensure_checkpoint_dir(spark)
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint dir for jobs that write and re-read data."""
    base = require_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tabsense-{name}-{uuid.uuid4().hex}"
