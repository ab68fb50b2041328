"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts here, as code points.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: For str.translate: A-Z to a-z, nothing else.
LOWER = {i: i + 32 for i in range(65, 91)}
#: A table of row keys or digests is sent to every executor up to this many rows (about 110 bytes each as a hash table); beyond, rows are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Folders that this process wrote and has not removed.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may have none: it gets a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="quartzloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder. Spark deletes checkpoints that nothing refers to where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def uncut(df: DataFrame) -> None:
    """Remove the files of a table of cut() at once: nothing may read it any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of the shared one. It stays until remove() or release()."""
    path = f"{shared_dir(spark).rstrip('/')}/quartzloom-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def store(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet to a path in the shared folder, and read it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are removed at its end."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            remove(spark, path)


def release(spark: SparkSession) -> None:
    """Remove the tables that results of this process still read: to be called once the results are written elsewhere."""
    for path in list(_written):
        remove(spark, path)


def text_key(text: str = "text") -> Column:
    """With doc_id, it tells rows apart: rows that agree in both are repeated rows."""
    return F.xxhash64(F.col(text))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until the table has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def id_ddl(df: DataFrame, name: str = "doc_id") -> str:
    """The id column as it is: ids may be of any type that has an order."""
    return f"{name} {df.schema[name].dataType.simpleString()}"


def without_rows(docs: DataFrame, drops: DataFrame, limit: int | None = None) -> DataFrame:
    """docs less the rows whose (doc_id, text_key()) is in drops (two columns, in this order, without repeats, already written).

    Texts stay where they are while drops has at most ``limit`` rows; beyond, both are dealt by the pair.
    """
    i, t, k = free_names(docs, "_drop_id", "_drop_text", "_text_key")
    drops = drops.toDF(i, t)
    if drops.count() <= (BROADCAST_ROWS if limit is None else limit):
        drops = F.broadcast(drops)
    rows = docs.withColumn(k, text_key())
    return rows.join(drops, rows["doc_id"].eqNullSafe(drops[i]) & rows[k].eqNullSafe(drops[t]), "left_anti").select(*docs.columns)


#: Bytes of an Arrow batch: with long texts, Spark's own bound would let a worker and its executor hold hundreds of MB.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow over small batches. The setting is read when the plan runs, so it stays lowered for the session."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, None)
    if now is not None and not now.startswith(str(BATCH_BYTES)):
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def by_rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that Python objects exist for few texts at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def record(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)
