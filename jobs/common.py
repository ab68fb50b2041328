"""What the jobs share: settings, a log, and the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


def log(job: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{job}")


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, with what a JSON file at a path of any file system says. A name that the job does not know is refused."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"]) if path else {}
    return checked(given, defaults)


def checked(given: dict | None, defaults: dict) -> dict:
    unknown = set(given or {}) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | (given or {})


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def observed(seen: Observation, name: str) -> int:
    """A count observed by a finished write. Where Spark finds that there can be no row, it leaves the observation out of the plan."""
    try:
        return seen.get[name] or 0
    except Py4JJavaError as e:
        if "toPyRow" not in str(e):
            raise
        return 0


def streamed(spark: SparkSession, path: str) -> str:
    """The path as a file stream takes it. A stream refuses a path that is one file, but takes the pattern that only this file matches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return path
    folder, _, name = path.rpartition("/")
    return f"{folder}/{{{name}}}" if folder else f"{{{name}}}"


def partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite those partitions of a table that the rows fall in, and no others. The session's own setting is not changed."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def command(doc: str, paths: dict[str, str], run: Callable[..., object], defaults: dict) -> None:
    """The command line of a job: a path for each name, and --config. The session is the cluster's, or a new one."""
    parser = argparse.ArgumentParser(description=doc.splitlines()[0])
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="JSON file of settings; " + ", ".join(f"{k} ({v})" for k, v in defaults.items()))
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(parser.prog).getOrCreate()
    try:
        run(spark, **{n: given[n] for n in paths}, config=settings(spark, given["config"], defaults))
    finally:
        spark.stop()
