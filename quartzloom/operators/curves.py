"""Ordered metric series: filling, smoothing, and detection of memorisation and delayed generalisation.

Each run is a window partition, and all frames are bounded except the fill. Thresholds follow the
defaults of training logs written every 100 epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_EVERY = 100


def steps(window: int) -> int:
    return max(1, window // LOG_EVERY)


def by_run(run: str = "run", epoch: str = "epoch"):
    return Window.partitionBy(run).orderBy(epoch)


def forward_fill(df: DataFrame, cols: list[str], run: str = "run", epoch: str = "epoch") -> DataFrame:
    """The last present value of each column; rows that still lack one go."""
    w = by_run(run, epoch).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols}).dropna(how="any", subset=cols)


def trailing_mean(value: str, w: int, run: str = "run", epoch: str = "epoch") -> Column:
    """Of w rows up to this one; null before there are w."""
    frame = by_run(run, epoch).rowsBetween(-(w - 1), 0)
    return F.when(F.count(value).over(frame) == w, F.avg(value).over(frame))


def centred_mean(value: str, w: int, run: str = "run", epoch: str = "epoch") -> Column:
    """Of w rows around this one, as many as there are; of an even w the greater part lies before."""
    after = (w - 1) // 2
    return F.avg(value).over(by_run(run, epoch).rowsBetween(-(w - 1 - after), after))


def first_epoch(df: DataFrame, predicate: Column, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """(run, first): the first epoch where the predicate holds, -1 if none."""
    return df.groupBy(run).agg(F.coalesce(F.min(F.when(predicate, F.col(epoch))), F.lit(-1)).alias("first"))


def initial_generalisation(df: DataFrame, val: str = "val", threshold: float = 0.75, window: int = 20, run: str = "run", epoch: str = "epoch") -> DataFrame:
    return first_epoch(df.withColumn("_s", trailing_mean(val, steps(window), run, epoch)), F.col("_s") > threshold, run, epoch)


def detect(df: DataFrame, overfit: float = 0.9, plateau: float = 0.75, jump: float = 0.05, window: int = 500, min_delay: int = 500, sustain: int = 3, train: str = "train", val: str = "val", run: str = "run", epoch: str = "epoch") -> DataFrame:
    """(run, mem, event, delay, detected): memorisation, the event after it, -1 where there is none.

    Memorisation: the first full trailing mean of train above ``overfit``. The event: the first row after it, more than
    ``min_delay`` later (one row at least), where the centred mean of val is below ``plateau``, rises by more than ``jump`` within a window,
    and then stays above ``plateau`` on average for (sustain - 1) windows. Runs of fewer than window * (sustain + 1) rows
    have neither.
    """
    w, later = steps(window), steps(min_delay)
    order = by_run(run, epoch)
    a = df.select(run, epoch, F.col(train).alias("_t"), F.col(val).alias("_v")).withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(run))})
    a = a.withColumns({"_tt": trailing_mean("_t", w, run, epoch), "_sm": centred_mean("_v", w, run, epoch)})
    first = (F.col("_n") >= w * (sustain + 1)) & (F.col("_tt") > overfit)
    a = a.withColumns({
        "_fi": F.min(F.when(first, F.col("_i"))).over(Window.partitionBy(run)), "_mem": F.min(F.when(first, F.col(epoch))).over(Window.partitionBy(run)),
        "_next": F.lead("_sm", w).over(order), "_post": F.sum("_sm").over(order.rowsBetween(w, sustain * w - 1)) / ((sustain - 1) * w),
    })
    event = (F.col("_i") > F.col("_fi")) & (F.col("_i") < F.col("_n") - sustain * w) & (F.col("_sm") < plateau) & (F.col("_i") - F.col("_fi") > later) & (F.col("_next") - F.col("_sm") > jump) & (F.col("_post") > plateau)
    out = a.groupBy(run).agg(F.coalesce(F.max("_mem"), F.lit(-1)).alias("mem"), F.coalesce(F.min(F.when(event, F.col(epoch))), F.lit(-1)).alias("event"))
    return out.withColumns({"delay": F.when((F.col("mem") != -1) & (F.col("event") != -1), F.col("event") - F.col("mem")).otherwise(-1), "detected": F.col("event") != -1})


def analyse(df: DataFrame, least: int = 100, **options) -> DataFrame:
    """Runs with their status (too_short below ``least`` rows after filling), events and first generalisation."""
    filled = forward_fill(df, ["train", "val"])
    status = df.select("run").distinct().join(filled.groupBy("run").agg(F.count("*").alias("_n")), "run", "left").select("run", F.when(F.coalesce("_n", F.lit(0)) < least, "too_short").otherwise("success").alias("status"))
    good = filled.join(status.filter("status = 'success'"), "run", "left_semi")
    return status.join(detect(good, **options), "run", "left").join(initial_generalisation(good).withColumnRenamed("first", "initial"), "run", "left")


def representatives(runs: DataFrame, frequency: DataFrame, n: int = 4) -> DataFrame:
    """(label, run) of the longest and shortest delay, the first run of the target with the highest frequency, and then
    the longest delays of targets not yet chosen, n in all.

    runs (run, target, delay) of detected events; frequency (target, freq). Each pick reads one row; targets chosen are
    n at most.
    """
    spark = runs.sparkSession
    picks: list[tuple[str, str]] = []
    targets: list[str] = []

    def take(label: str, df: DataFrame, *order) -> None:
        for r in df.orderBy(*order).limit(1).collect():
            picks.append((label.format(delay=int(r["delay"])), r["run"]))
            targets.append(r["target"])

    take("Longest Delay", runs, F.desc("delay"), "run")
    take("Shortest Delay", runs, "delay", "run")
    top = [r["target"] for r in frequency.filter("freq is not null").orderBy(F.desc("freq"), "target").limit(1).collect()]
    if top and top[0] not in targets:
        take("Highest Frequency", runs.filter(F.col("target") == top[0]), "run")
    if len(picks) < n:
        left = runs.filter(~F.col("target").isin(targets)) if targets else runs
        best = left.withColumn("_r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("delay"), "run"))).filter("_r = 1")
        for r in best.orderBy(F.desc("delay"), "run").limit(n - len(picks)).collect():
            picks.append((f"Mid Delay ({int(r['delay'])})", r["run"]))
    return spark.createDataFrame(picks, "label string, run string")
