"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of the ring of 64-bit hashes. A row lies where the hash of its
doc_id falls, and belongs to the next point clockwise; rows that would overflow a full shard
continue clockwise. Capacities are exact (the counts of shards differ by at most one), so the law
is ``rows``. How rows overflow is worked out from the number of rows on each arc alone: at most
shards * vnodes numbers, whatever the input.

Rows are dealt in ring order by range, and numbered by their place in it; a table of at most a few
thousand rank intervals then gives shard and slot. Rows of equal doc_id are told apart by a seeded
draw, so one id with a third of all rows spreads over many tasks.

Defined cases: null texts have size 8 and the checksum of no bytes; texts of any length count whole;
a null doc_id is a key like any other, ids may be of any type; repeated rows are placed each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.llm.common import cut, id_ddl, map_arrow, record

SHARDS, VNODES = 24, 256
OUT = pa.schema([("size", pa.int64()), ("text_crc32", pa.int64()), ("law", pa.string()), ("shard", pa.int32()), ("slot", pa.int64()), ("grown_shard", pa.int32()), ("home_shard", pa.int32())])
OUT_DDL = "size long, text_crc32 long, law string, shard int, slot long, grown_shard int, home_shard int"


def ring(shards: int = SHARDS, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """The points, ascending, and the shard of each."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}", 7) - (1 << 63), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def overflow(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int]]:
    """For rows on each arc, in ring order: (arc, shard, rows) runs, none beyond a shard's capacity.

    Every arc first gives its owner what fits there; the rest walks clockwise, what has waited longest first.
    """
    room, left, runs, waiting = capacity.copy(), counts.copy(), [[] for _ in owner], deque()
    for arc, shard in enumerate(owner.tolist()):
        if used := min(int(left[arc]), int(room[shard])):
            runs[arc].append((shard, used))
            left[arc] -= used
            room[shard] -= used
    for turn in range(2):
        for arc, shard in enumerate(owner.tolist()):
            if turn == 0 and left[arc]:
                waiting.append((arc, int(left[arc])))
            while waiting and room[shard]:
                who, n = waiting.popleft()
                used = min(n, int(room[shard]))
                room[shard] -= used
                runs[who].append((shard, used))
                if n > used:
                    waiting.appendleft((who, n - used))
    assert not waiting, "capacities hold all rows"
    return [(arc, shard, n) for arc, own in enumerate(runs) for shard, n in own]


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard): home_shard is the owner of the row's arc."""
    points, owner = ring(shards, vnodes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id").alias("h"))
    rows = cut(rows)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # in ring order; the draw parts rows of one id, and the bounds of ranges are sampled from these two numbers only
    rows = cut(rows.withColumn("draw", F.rand(11)).repartitionByRange(n, "h", "draw").sortWithinPartitions("h", "draw").drop("draw").withColumn("task", F.spark_partition_id()))

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("task", pa.int32()), ("arc", pa.int32()), ("n", pa.int64())])
        for part in batches:
            arc = np.searchsorted(points, part.column(0).to_numpy()) % len(points)
            kinds, many = np.unique(arc, return_counts=True)
            yield record(schema, [part.column(1)[0].as_py()] * len(kinds) if part.num_rows else [], kinds.astype(np.int32), many)

    counted = map_arrow(rows.select("h", "task"), arcs, "task int, arc int, n long").groupBy("task", "arc").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    by_task = dict(counted.groupBy("task").agg(F.sum("n")).collect())  # a row for each task
    counts = np.zeros(len(points), np.int64)
    for arc, many in counted.groupBy("arc").agg(F.sum("n")).collect():  # a row for each arc of the ring
        counts[arc] = many
    total = int(counts.sum())
    capacity = total // shards + (np.arange(shards) < total % shards)
    starts, at = {}, 0
    for task in sorted(by_task):
        starts[task], at = at, at + by_task[task]
    beyond = rows.filter(F.col("h") > int(points[-1])).count()  # they belong to the first point, so the order of places starts with them
    runs = overflow(counts, owner, capacity)
    lo, shard, slot, filled, rank = [], [], [], np.zeros(shards, np.int64), {}
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    for arc, s, many in runs:
        r = rank.get(arc, int(first[arc]))
        lo.append(r), shard.append(s), slot.append(int(filled[s]))
        filled[s] += many
        rank[arc] = r + many
    order = np.argsort(np.array(lo, np.int64), kind="stable")
    lo, shard, slot = (np.array(x, np.int64)[order] for x in (lo, shard, slot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for part in batches:
            if not part.num_rows:
                continue
            base = starts[part.column(4)[0].as_py()]
            arc = np.searchsorted(points, part.column(3).to_numpy()) % len(points)
            place = (base + seen + np.arange(part.num_rows) + beyond) % total
            seen += part.num_rows
            i = np.searchsorted(lo, place, "right") - 1
            size = part.num_rows
            rest = record(OUT, part.column(1), part.column(2), ["rows"] * size, shard[i].astype(np.int32), slot[i] + place - lo[i], pa.nulls(size, pa.int32()), owner[arc].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), *rest.columns], names=["doc_id", *OUT.names])

    return map_arrow(rows.select("doc_id", "size", "text_crc32", "h", "task"), run, f"{id_ddl(docs)}, {OUT_DDL}")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
