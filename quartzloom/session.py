"""A session for tests, benchmarks and local use. Cluster jobs bring their own session."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with UTC, ANSI mode and AQE. Workers find this library wherever the driver runs."""
    root = str(Path(__file__).resolve().parents[1])
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    os.environ["PYTHONPATH"] = os.pathsep.join([root, *(p for p in paths if p and p != root)])
    out = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quartzloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may have none: it gets a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="quartzloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df):
    """The rows, checkpointed in the shared folder. Spark deletes checkpoints that nothing refers to where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written to the shared folder and read again, and where they are, for discard().

    For the tables of a loop: a checkpoint keeps the size that was estimated for its plan. Joins multiply sizes, so that from
    round to round the estimate's digits double, until the driver does nothing but multiply. Files have a size of their own.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quartzloom-round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove what stored() wrote: nothing may read it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
