"""Session settings and shared-storage materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app_name: str = "voxelgrain", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or get) a session with adaptive execution, skew handling and UTC time."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; only local sessions may fall back to a temporary one."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="voxelgrain-")
    context.setCheckpointDir(folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, honouring the cluster's folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several later branches read, and return the written copy.

    A written table survives the loss of executors and lets each reader prune columns,
    which a cached plan of the same size would not.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def never_broadcast(df: DataFrame) -> DataFrame:
    """The table, whose next joins shuffle both sides.

    Spark takes a written table for as large as its files and spelt-out rows for as large as what they are spelt out from. Rows of
    pixels are dozens of times larger than either, so such a table would pass for a small one and go through the driver whole.
    """
    return df.hint("merge")
