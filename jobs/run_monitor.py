"""Follows training runs: takes new files of measured events and brings the analysis of the runs they touch up to date.

    python -m jobs.run_monitor --events E --out O --checkpoint C [--config jobs/run_monitor.json]

E is a folder of Parquet files (event_id, ts, user_id, event_type, value) that grows, or one file; a user is a run, its events in
order of time are its epochs. Each start takes the files that the checkpoint does not name yet, in batches of
``files_per_batch``, and ends. A batch

1. is written to O/points/batch=<number>/bucket=<n>, where a run's bucket is a hash of it among ``buckets``: a batch that
   is taken again after a failure replaces itself;
2. finds the buckets it touches (at most ``buckets`` numbers are read), reads the points of these alone, by partition, and
   analyses their runs: status, memorisation, delayed event, first generalisation;
3. overwrites these buckets of O/runs, and no others; O/runs is right for all points taken, at any moment.

O and C belong together. A start without new files changes nothing. Within a bucket all runs are analysed anew, so
``buckets`` should grow with the number of runs; it is fixed by the first start of an output, as the results are
partitioned by it, and another number is refused. Events of a null run are a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import checked, command, exists, log, partitioned, streamed
from quartzloom.operators import curves, splits

DEFAULTS = {"buckets": 16, "files_per_batch": 1000, "least": 60, "overfit": 0.5, "plateau": 0.5, "jump": 0.05, "window": 500, "min_delay": 500, "sustain": 3}
POINTS = "run long, ts timestamp, event_id long, value double"


def points_of(events: DataFrame, buckets: int) -> DataFrame:
    run = F.col("user_id").cast("long").alias("run")
    return events.select(run, F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"), F.pmod(F.xxhash64(run), F.lit(buckets)).cast("int").alias("bucket"))


def series(points: DataFrame) -> DataFrame:
    """(run, epoch, train, val): an epoch of 100 steps an event. A null value is a gap; training progress is the share of 40 events."""
    numbered = splits.ranked(points, ["run"], "ts", "event_id", name="i")
    return numbered.select("run", ((F.col("i") - 1) * curves.LOG_EVERY).cast("int").alias("epoch"), (F.col("value") / 100).alias("val"), F.least(F.lit(1.0), F.col("i") / 40).alias("train"))


def analysis(points: DataFrame, c: dict) -> DataFrame:
    found = curves.analyse(series(points), c["least"], **{k: c[k] for k in ("overfit", "plateau", "jump", "window", "min_delay", "sustain")})
    return found.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(c["buckets"])).cast("int"))


def runs(spark: SparkSession, out: str) -> DataFrame:
    """The analysis as it stands."""
    return spark.read.parquet(f"{out}/runs")


def monitor(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Takes what is new and ends; returns the counts that it logs."""
    c, say, done = checked(config, DEFAULTS), log("run_monitor"), {"batches": 0, "read": 0, "runs": 0}
    settled = f"{out}/settings"
    if exists(spark, settled):
        first = spark.read.json(settled).first()["buckets"]
        if first != c["buckets"]:
            raise ValueError(f"{out} has {first} buckets, not {c['buckets']}")
    else:
        spark.range(1).select(F.lit(c["buckets"]).alias("buckets")).write.mode("overwrite").json(settled)

    def take(batch: DataFrame, number: int) -> None:
        session, mine = batch.sparkSession, f"{out}/points/batch={number}"
        points_of(batch, c["buckets"]).write.mode("overwrite").partitionBy("bucket").parquet(mine)
        new = session.read.schema(f"{POINTS}, bucket int").parquet(mine)
        touched = {r["bucket"]: r["n"] for r in new.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        if touched:
            known = session.read.schema(f"{POINTS}, batch long, bucket int").parquet(f"{out}/points")
            partitioned(analysis(known.filter(F.col("bucket").isin(list(touched))), c), f"{out}/runs", "bucket")
        done["batches"] += 1
        done["read"] += sum(touched.values())
        say.info("batch %d: read %d events, wrote the runs of %d of %d buckets", number, sum(touched.values()), len(touched), c["buckets"])

    source = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(streamed(spark, events))
    query = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done["runs"] = runs(spark, out).count() if exists(spark, f"{out}/runs") else 0
    say.info("took %(batches)d batches of %(read)d events; %(runs)d runs are known", done)
    return done


if __name__ == "__main__":
    command(__doc__, {"events": "folder of event files", "out": "folder to write", "checkpoint": "folder of the stream's checkpoint"}, monitor, DEFAULTS)
