"""Streaming forms of batch operators: incremental moments, an append log, and curve events with a delay.

The reference semantics are batch ones; these are extensions with the same results once a stream
has been read to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.operators.curves import steps


def running_moments(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n, mean, var) so far by key, population variance: mergeable aggregates, so state is three numbers a key."""
    return stream.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def append_log(stream: DataFrame, path: str, checkpoint: str, every: str = "10 seconds"):
    """Micro-batches appended to a Parquet log; a batch that is written again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Rows by window and key, closed by a watermark. Timestamps without a zone are read as UTC."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def curve_events(stream: DataFrame, overfit: float = 0.9, plateau: float = 0.75, jump: float = 0.05, window: int = 500, min_delay: int = 500, sustain: int = 3):
    """(run, mem, event) once an event is certain: rows (run, epoch, train, val) come in epoch order, and a candidate is decided when sustain windows have followed it.

    State of a run is the last rows that a decision can still need, not the whole curve. A missing metric is the last
    one seen, as in forward_fill(); rows before both have been seen, and rows no later than the last one, are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    w, later = steps(window), steps(min_delay)
    keep = sustain * w + w

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, mem, done, seen, epochs, train, val, last, t0, v0 = state.get if state.exists else (-1, -1, False, 0, [], [], [], None, None, None)
        epochs, train, val = list(epochs), list(train), list(val)
        rows = pd.concat(list(batches)).sort_values("epoch")
        found = []
        for e, t, v in rows[["epoch", "train", "val"]].itertuples(index=False):
            t0, v0 = t0 if pd.isna(t) else float(t), v0 if pd.isna(v) else float(v)
            if t0 is None or v0 is None or (last is not None and e <= last):
                continue
            last = int(e)
            epochs.append(last), train.append(t0), val.append(v0)
            seen += 1
            if mem < 0 and len(train) >= w and np.mean(train[-w:]) > overfit:
                first, mem = seen - 1, int(e)
            base, i = seen - len(val), seen - 1 - sustain * w - (w - 1) // 2
            if not done and mem >= 0 and i > first and i - first > later and i >= base:
                after = (w - 1) // 2
                sm = lambda k: np.mean(val[max(0, k - base - (w - 1 - after)) : k - base + after + 1])
                if sm(i) < plateau and sm(i + w) - sm(i) > jump and np.mean([sm(k) for k in range(i + w, i + sustain * w)]) > plateau:
                    done = True
                    found.append((key[0], mem, epochs[i - base]))
            if len(epochs) > keep + w:
                epochs, train, val = epochs[1:], train[1:], val[1:]
        state.update((first, mem, done, seen, epochs, train, val, last, t0, v0))
        yield pd.DataFrame(found, columns=["run", "mem", "event"])

    return stream.groupBy("run").applyInPandasWithState(run, "run long, mem int, event int", "first int, mem int, done boolean, seen int, epochs array<int>, train array<double>, val array<double>, last int, t0 double, v0 double", "append", GroupStateTimeout.NoTimeout)
