"""Durable tables of batches in a shared folder, with a manifest, and texts by digest.

A store is a folder of run folders and numbered manifests. A batch writes its run first and then
the next manifest, by a rename that fails where another writer was faster; what no manifest names
does not count, so a lost driver or executor leaves the store as it was before the batch. A batch
has a name, and one that the manifest already has is not added again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzloom.llm import common
from quartzloom.llm.common import cut


#: Bytes of texts that are moved for the sake of even work.
SPREAD_BYTES = 64 << 20


class Manifest:
    """The state of a store, a JSON object. Reopening reads the newest one."""

    def __init__(self, spark: SparkSession, path: str, start: dict):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self.at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self.fs = self.at("x").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.at("manifests"))
        self.number, self.state = -1, start
        self.read()

    def read(self) -> dict:
        names = sorted(f.getPath().getName() for f in self.fs.listStatus(self.at("manifests")))
        done = [n for n in names if n.endswith(".json")]
        if done:
            self.number = int(done[-1].split(".")[0])
            stream = self.fs.open(self.at(f"manifests/{done[-1]}"))
            try:
                self.state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self.state

    def commit(self, state: dict) -> None:
        part, whole = self.at(f"manifests/{uuid.uuid4().hex}.part"), self.at(f"manifests/{self.number + 1:08d}.json")
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if self.fs.exists(whole) or not self.fs.rename(part, whole):
            self.fs.delete(part, False)
            raise RuntimeError(f"another writer has changed {self.path}")
        self.number, self.state = self.number + 1, state

    def new_run(self, name: str) -> str:
        return f"{name}-{uuid.uuid4().hex}"

    def drop(self, run: str) -> None:
        self.fs.delete(self.at(run), True)


class BatchTable:
    """A table that grows by named batches, each a Parquet folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema = spark, schema
        self.manifest = Manifest(spark, path, {"batches": {}})

    def has(self, batch: str) -> bool:
        return batch in self.manifest.state["batches"]

    def read(self) -> DataFrame:
        runs = [f"{self.manifest.path}/{r}" for r in self.manifest.state["batches"].values() if r]
        return self.spark.read.schema(self.schema).parquet(*runs) if runs else self.spark.createDataFrame([], self.schema)

    def append(self, batch: str, rows: DataFrame) -> None:
        """Add a batch; nothing is done where the store has it."""
        if self.has(batch):
            return
        run = self.manifest.new_run("run")
        rows.write.parquet(f"{self.manifest.path}/{run}")
        self.manifest.commit({"batches": self.manifest.state["batches"] | {batch: run}})

    def compact(self) -> None:
        """All runs in one, rows unchanged."""
        old = self.manifest.state["batches"]
        if len({r for r in old.values() if r}) < 2:
            return
        run = self.manifest.new_run("run")
        self.read().write.parquet(f"{self.manifest.path}/{run}")
        first = next(iter(old))
        self.manifest.commit({"batches": {b: run if b == first else "" for b in old}})
        for r in old.values():
            self.manifest.drop(r) if r else None


def content(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def digest(text: str = "text") -> Column:
    """SHA-256 of a text's UTF-8 bytes; a null text is empty."""
    return F.unhex(F.sha2(content(text).cast("binary"), 256))


def unseen(docs: DataFrame, wanted: list[str], seen: DataFrame | None = None, ident: str = "doc_id") -> DataFrame:
    """(digest, text, todo): a text for each different digest; bit i of todo is set where ``seen`` (digest, done) lacks wanted[i] for it. Digests that lack nothing are left out.

    Only digests and ids are shuffled first. Then the texts are read once more and stay in place, as long as the digests
    to be left out (or held back as copies), or else those to be taken, number BROADCAST_ROWS at most; only beyond that
    are texts joined by a shuffle, dealt by digest and id, so that copies of a hot text spread. The text of a digest is
    that of its least id; rows that agree in id and text may give a digest more than once. Texts of SPREAD_BYTES in all
    are dealt evenly to the tasks, as a small table may be one piece of a file.
    """
    if len(wanted) > 63:
        raise ValueError("at most 63 at a time")
    every = (1 << len(wanted)) - 1
    rows = docs.select(digest().alias("digest"), F.col(ident).alias("id"), F.octet_length(content()).alias("size"))
    table = rows.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.max("size").alias("size"))
    if seen is None:
        table = table.withColumn("todo", F.lit(every).cast("long"))
    else:
        bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.array_contains("done", w), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, w in enumerate(wanted)))
        done = seen.select("digest", bits.alias("done")).groupBy("digest").agg(F.bit_or("done").alias("done"))
        table = table.join(done, "digest", "left").withColumn("todo", F.lit(every).cast("long").bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("long"))))).drop("done")
    table = cut(table)
    take, special = F.col("todo") != 0, (F.col("n") > 1) | (F.col("todo") != every)
    n_take, n_special, size = table.agg(F.count_if(take), F.count_if(special), F.sum(F.when(take, F.col("size")).cast("long"))).first()
    spread = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if (size or 0) <= SPREAD_BYTES else df
    texts = docs.select(digest().alias("digest"), F.col(ident).alias("id"), content().alias("text"))
    if n_special <= min(n_take, common.BROADCAST_ROWS):
        listed = F.broadcast(table.filter(special).select("digest", "rep", "todo"))
        found = texts.join(listed, "digest", "left").filter(F.col("todo").isNull() | ((F.col("todo") != 0) & F.col("id").eqNullSafe(F.col("rep"))))
        return spread(found.select("digest", "text", F.coalesce("todo", F.lit(every).cast("long")).alias("todo")))
    listed = table.filter(take).select(F.col("digest").alias("taken"), "rep", "todo")
    if n_take <= common.BROADCAST_ROWS:
        listed = F.broadcast(listed)
    return spread(texts.join(listed, (F.col("digest") == F.col("taken")) & F.col("id").eqNullSafe(F.col("rep"))).select("digest", "text", "todo"))
