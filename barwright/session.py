"""Session settings the engine relies on."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; ``master`` only where none is configured."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = SparkSession.builder.appName("barwright")
    if master:
        builder = builder.master(master)
    settings = SETTINGS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Only a driver that runs all tasks itself may do without: a temporary one is set there.
    Elsewhere a folder of this machine would be lost to the executors, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = named or context.getCheckpointDir() or f"{tempfile.gettempdir()}/barwright-checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder; survives the loss of executors.

    ``spark.cleaner.referenceTracking.cleanCheckpoints``, set by ``session``, removes it when
    nothing refers to it any more.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, for tables that ``discard`` removes."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def visible(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    A cluster gets it with --py-files or an image; there the extra path does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    held = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in held:
        environment["PYTHONPATH"] = os.pathsep.join([*held, root])
