"""Session helpers: building a local session for tests and finding the
shared checkpoint folder that lineage cuts are written to."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CHECKPOINT_DIR: str | None = None


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench: local master, AQE on, UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rivalry")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RIVALRY_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be present (a machine-local folder would be
    lost with its executor). Only a local-mode session without the setting
    (tests) gets a private temporary folder.
    """
    global _LOCAL_CHECKPOINT_DIR
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/object store) before running order-dependent operators"
        )
    if _LOCAL_CHECKPOINT_DIR is None:
        _LOCAL_CHECKPOINT_DIR = tempfile.mkdtemp(prefix="rivalry-ckpt-")
    sc.setCheckpointDir(_LOCAL_CHECKPOINT_DIR)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and read it back: later consumers see one fixed copy (with column
    pruning), and a lost executor never forces a recompute of the upstream
    shuffle. One write job, unlike an RDD checkpoint (compute, then write)."""
    import uuid

    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/rivalry-cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
