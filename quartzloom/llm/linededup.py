"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed table of (h1, h2, n): the 128-bit hash of a line's key and the number of
documents with it, in one sorted file a bucket of the hash. Each batch of documents is reduced to
such counts, merge-anti-joined against keys that the runs already hold often enough, and added as a
run of level 0. Once a level has ``fanout`` runs they are merged, two at a time, into one run of
the next level. Joins between runs and merges neither shuffle nor sort: buckets match, and files
are in order. ``LineRuns`` keeps runs and a manifest in a shared folder, so that a later session
goes on where this one ended; a batch has a name and is counted once.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased.
Keys of at least ``min_chars`` code points that are in at least ``min_docs`` documents lose all
their lines. Frequent keys go to the tasks that read the texts, up to BROADCAST_KEYS of them, so
texts are not shuffled; more keys are joined to the documents' keys, and the lines that a document
loses to its text.

Defined cases: null and empty texts are one empty line; texts and lines of any length are whole;
each row counts as a document, repeated rows too; keys of no code points are never counted; ids may
be null and of any type; an empty table gives no rows; other columns, whatever their names, are
ignored by ``dedup_lines`` and kept by ``drop_lines``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzloom.llm.common import by_rows, cut, free_names, id_ddl, map_arrow, new_path, record, remove, text_key, uncut
from quartzloom.llm.store import Manifest

STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHARS, MIN_DOCS = 1, 10
#: Up to this many frequent lines are sent to every worker (about 100 bytes each there).
BROADCAST_KEYS = 500_000
KEYS = pa.schema([("h1", pa.int64()), ("h2", pa.int64())])


def hashes(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """A text's lines, and each one's hash (empty where it has too few code points)."""
    lines = (text or b"").split(b"\n")
    out = []
    for line in lines:
        key = line.strip(STRIP).lower()  # bytes.lower: A-Z only
        short = len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars)
        out.append(b"" if short else xxhash.xxh3_128_digest(key))
    return lines, out


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def whole(h1: int, h2: int) -> bytes:
    return h1.to_bytes(8, "big", signed=True) + h2.to_bytes(8, "big", signed=True)


def distinct_keys(part: pa.Array, min_chars: int) -> tuple[pa.Array, np.ndarray]:
    """For texts: the place of the text, and (h1, h2), of each different key in each."""
    found = [[d for d in dict.fromkeys(hashes(t, min_chars)[1]) if d] for t in part.to_pylist()]
    return pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])), halves([d for f in found for d in f])


def text_bytes(docs: DataFrame):
    return docs["text"].cast("string").cast("binary").alias("text")


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = 1) -> DataFrame:
    """(batch, h1, h2), once for each different key of a document. Documents are dealt to batches by their texts."""
    schema = pa.schema([("batch", pa.int32()), *KEYS])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_rows(rows):
            at, both = distinct_keys(part.column(1), min_chars)
            yield record(schema, part.column(0).take(at), both[:, 0], both[:, 1])

    return map_arrow(docs.select(F.pmod(text_key(), F.lit(batches)).cast("int").alias("batch"), text_bytes(docs)), run, "batch int, h1 long, h2 long")


def counted(keys: DataFrame) -> DataFrame:
    """(batch, h1, h2, n): reduced before the shuffle, so a line of every document crosses it once a task."""
    return keys.groupBy("batch", "h1", "h2").agg(F.count("*").alias("n"))


class LineRuns:
    """The runs of one corpus, in a folder that all executors share. Opening the folder again goes on with what it holds."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, min_docs: int = MIN_DOCS, buckets: int | None = None):
        self.spark = spark
        start = {"levels": [], "batches": [], "fanout": fanout, "min_docs": min_docs, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))}
        self.manifest = Manifest(spark, path, start)

    @property
    def levels(self) -> list[list[str]]:
        return self.manifest.state["levels"]

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def table(self, run: str) -> DataFrame:
        """A run with its buckets and their order; the catalog learns of it when it is first read in a session."""
        name = "quartzloom_" + run.replace("-", "_")
        if not self.spark.catalog.tableExists(name):
            n = self.manifest.state["buckets"]
            self.spark.sql(f"create table {name} (h1 bigint, h2 bigint, n bigint) using parquet clustered by (h1, h2) sorted by (h1, h2) into {n} buckets location '{self.manifest.path}/{run}'")
        return self.spark.table(name)

    def forget(self, runs: list[str]) -> None:
        for r in runs:
            self.spark.sql(f"drop table if exists quartzloom_{r.replace('-', '_')}")
            self.manifest.drop(r)

    def write(self, counts: DataFrame) -> str:
        """Rows that lie in their buckets already, as a new run: a file for each bucket."""
        run = self.manifest.new_run("run")
        n, name = self.manifest.state["buckets"], "quartzloom_" + run.replace("-", "_")
        self.ordered(lambda: counts.write.bucketBy(n, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.manifest.path}/{run}").saveAsTable(name))
        return run

    def ordered(self, action: Callable[[], object]) -> object:
        """Plan and run with Spark trusting the order of bucket files, of which each bucket has one."""
        key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            return action()
        finally:
            self.spark.conf.set(key, before)

    def merged(self, runs: list[str]) -> DataFrame:
        """The sum of runs, by merge joins of two at a time; with more than two it is written in between."""
        out = self.table(runs[0])
        for r in runs[1:]:
            a, b = out.alias("a"), self.table(r).alias("b")
            both = a.join(b.hint("merge"), (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full")
            out = both.select(F.coalesce("a.h1", "b.h1").alias("h1"), F.coalesce("a.h2", "b.h2").alias("h2"), (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))
        return out

    def add(self, batch: str, counts: DataFrame) -> None:
        """A batch of counts (h1, h2, n); nothing is done where the manifest has its name."""
        state = self.manifest.state
        if batch in state["batches"]:
            return
        new = counts.select("h1", "h2", "n").repartition(state["buckets"], "h1", "h2")
        for r in self.runs():  # what one run holds often enough needs no more counting
            held = self.table(r).filter(F.col("n") >= state["min_docs"])
            new = new.join(held.hint("merge"), ["h1", "h2"], "left_anti")
        levels = [list(x) for x in self.levels] or [[]]
        levels[0].append(self.write(new))
        gone, made, at = [], [levels[0][-1]], 0
        try:
            while len(levels[at]) >= state["fanout"]:
                old, levels[at] = levels[at], []
                if at + 1 == len(levels):
                    levels.append([])
                run = old[0]
                for r in old[1:]:
                    last, run = run, self.write(self.merged([run, r]))
                    made.append(run)
                    gone += [last, r]
                levels[at + 1].append(run)
                at += 1
            self.manifest.commit(state | {"levels": levels, "batches": [*state["batches"], batch]})
        except BaseException:
            self.forget(made)
            raise
        self.forget(gone)

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys in at least min_docs documents. Up to two runs are merged as they lie."""
        runs, least = self.runs(), F.col("n") >= self.manifest.state["min_docs"]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        if len(runs) <= 2:
            return self.merged(runs).filter(least).select("h1", "h2")
        parts = [self.table(r) for r in runs]
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.union(p)
        return all_.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(least).select("h1", "h2")

    def close(self) -> None:
        """Remove runs, manifests and folder."""
        self.forget(self.runs())
        remove(self.spark, self.manifest.path)


def frequent_keys(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """(h1, h2), written: the keys that lose their lines. The texts are read once; the batches' counts are added to runs one after another."""
    spark = docs.sparkSession
    counts = cut(counted(line_keys(docs, min_chars, batches)))
    runs = LineRuns(spark, new_path(spark, "runs"), fanout=2, min_docs=min_docs)  # the second batch makes a merge due
    try:
        for b in range(batches):
            runs.add(str(b), counts.filter(F.col("batch") == b))
        return runs.ordered(lambda: cut(runs.frequent()))
    finally:
        runs.close()
        uncut(counts)


def without(text: bytes | None, gone: frozenset[bytes] | set[bytes], min_chars: int) -> tuple[int, int, bytes]:
    """Lines, lines dropped, and what stays."""
    if not gone:
        return (text or b"").count(b"\n") + 1, 0, text or b""
    lines, found = hashes(text, min_chars)
    keep = [line for line, h in zip(lines, found, strict=True) if h not in gone]
    return len(lines), len(lines) - len(keep), b"\n".join(keep)


def cleaned(docs: DataFrame, rewrite: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: str, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """rewrite(rows, [without() of each]) of docs with a column text."""
    spark, kept = docs.sparkSession, docs.columns
    frequent = frequent_keys(docs, min_chars, min_docs, batches)
    at = kept.index("text")
    texts = lambda part: part.column(at).cast(pa.binary()).to_pylist()
    if (n := frequent.count()) <= BROADCAST_KEYS:
        held = spark.sparkContext.broadcast([whole(*r) for r in frequent.collect()]) if n else None  # BROADCAST_KEYS at most

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gone = frozenset(held.value) if held else frozenset()
            for part in by_rows(rows):
                yield rewrite(part, [without(t, gone, min_chars) for t in texts(part)])

        return map_arrow(docs, run, schema)
    i, k, lost_name = free_names(docs, "_lost_id", "_lost_key", "_lost")
    keyed = pa.schema([("text_key", pa.int64()), *KEYS])

    def own(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_rows(rows):
            place, both = distinct_keys(part.column(2), min_chars)
            yield pa.RecordBatch.from_arrays([part.column(0).take(place), *record(keyed, part.column(1).take(place), both[:, 0], both[:, 1]).columns], names=["doc_id", *keyed.names])

    keys = map_arrow(docs.select("doc_id", text_key().alias("text_key"), text_bytes(docs)), own, f"{id_ddl(docs)}, text_key long, h1 long, h2 long")
    lost = keys.join(frequent, ["h1", "h2"], "left_semi").groupBy(F.col("doc_id").alias(i), F.col("text_key").alias(k)).agg(F.collect_set(F.struct("h1", "h2")).alias(lost_name))
    both = docs.join(lost, docs["doc_id"].eqNullSafe(F.col(i)) & text_key().eqNullSafe(F.col(k)), "left").drop(i, k)

    def run_joined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_rows(rows):
            drops = [{whole(d["h1"], d["h2"]) for d in x or ()} for x in part.column(len(kept)).to_pylist()]
            yield rewrite(part.select(kept), [without(t, d, min_chars) for t, d in zip(texts(part), drops, strict=True)])

    return map_arrow(both, run_joined, schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): a row for each row."""
    rest = pa.schema([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.binary())])

    def rewrite(part: pa.RecordBatch, done: list) -> pa.RecordBatch:
        new = record(rest, *([x[i] for x in done] for i in range(3)))
        return pa.RecordBatch.from_arrays([part.column(0), new.column(0), new.column(1), new.column(2).cast(pa.string())], names=["doc_id", *rest.names])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return cleaned(rows, rewrite, f"{id_ddl(docs)}, n_lines long, n_dropped long, text string", min_chars, min_docs, batches)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 3) -> DataFrame:
    """The documents with their remaining text, and its length in n_chars where there is such a column. Untouched rows stay as they are."""
    kept = docs.columns
    at = kept.index("text")

    def rewrite(part: pa.RecordBatch, done: list) -> pa.RecordBatch:
        old = part.column(at)
        new = pa.array([x[2] if x[1] else t for x, t in zip(done, old.cast(pa.binary()).to_pylist(), strict=True)], pa.binary()).cast(old.type)
        return pa.RecordBatch.from_arrays([new if i == at else part.column(i) for i in range(len(kept))], names=kept)

    out = cleaned(docs, rewrite, docs.schema, min_chars, min_docs, batches)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in kept else out


def op6_linededup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id, r
"""
