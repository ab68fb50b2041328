"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints with at most three differing bits
differ in at most three bytes, so they share at least five of the eight positional bytes: the
guaranteed minimum. Posting lists of single positional bytes would hold 1/256 of the corpus each,
so a list here is for three positional bytes: positions 0-3 and 4-7 have four triples each, and
five shared positions put three into one half, so every pair that must be found meets in one of
eight lists of 24-bit keys. For each pair in a list the shared positional bytes are tallied; pairs
below five go without their bits being counted, and the differing bits of the rest decide. The
tally is a necessary condition and spares work; what links is the count of bits.

A list is read in key order by one task that keeps fingerprints (8 bytes each), not texts. Lists
of over BLOCK fingerprints are dealt as pairs of blocks to many tasks. From each list or block
pair a spanning forest of the links is written, never all pairs: it has the same components.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links
like any other; texts of any length are hashed whole; equal fingerprints link; repeated rows give
repeated rows; ids are of any type that has an order; a null doc_id gets the component of its
fingerprint and never names one unless all are null; an empty table gives no rows; other columns,
whatever their names, are ignored by ``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzloom.llm.common import LOWER, by_rows, cut, free_names, id_ddl, map_arrow, record, text_key, without_rows
from quartzloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SEED, SHINGLE, MAX_BITS, MIN_BYTES = 42, 3, 3, 5
#: Byte positions of each list: the triples of both halves.
LISTS = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
BLOCK = 2048
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit number. Bit 63 is the highest bit of the hashes."""
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_digest
    ends = np.cumsum([len(w.encode()) + 1 for w in words]).tolist()
    flat, starts = " ".join(words).encode(), [0, *ends]
    size = min(SHINGLE, len(words))
    hashes = b"".join([digest(flat[starts[i] : starts[i + size] - 1], SEED) for i in range(n)])
    ones = np.zeros(64, np.int64)
    step = 1 << 16
    for i in range(0, n, step):
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8, offset=8 * i, count=8 * min(step, n - i)).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, fp), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_rows(batches):
            prints = pa.array([fingerprint(t) for t in part.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), prints], names=["doc_id", "tk", "fp"])

    return map_arrow(docs.select("doc_id", text_key().alias("tk"), F.col("text").cast("string").alias("text")), run, f"{id_ddl(docs)}, tk long, fp long")


def linked(x: np.ndarray) -> np.ndarray:
    """For XORs of fingerprints: the positional tally reaches the minimum, and few bits differ."""
    shared = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)
    out = shared >= MIN_BYTES
    out[out] = np.bitwise_count(x[out]) <= MAX_BITS
    return out


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sets of fingerprints, as chains through each component. Compared in strips, so memory follows BLOCK."""
    nodes = np.unique(np.concatenate([left, right]))
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at = np.searchsorted(nodes, right)
    for k in range(0, len(left), 128):
        strip = left[k : k + 128]
        i, j = np.nonzero(linked(strip[:, None] ^ right[None, :]))
        mine = np.searchsorted(nodes, strip)
        for p, q in zip(mine[i].tolist(), at[j].tolist(), strict=True):
            parent[root(p)] = root(q)
    groups = np.array([root(i) for i in range(len(nodes))])
    order = np.argsort(groups, kind="stable")
    same = groups[order][1:] == groups[order][:-1]
    return nodes[order][:-1][same], nodes[order][1:][same]


def list_links(key: np.ndarray, fp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole lists in key order. side: 0 for the first block of a pair, 1 for the second, 2 where a list is one block."""
    a, b = [], []
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    small = np.repeat(size <= 16, size)
    for s in range(1, 16):  # short lists, all at once
        i = np.flatnonzero((key[s:] == key[:-s]) & small[s:] & (side[s:] + side[:-s] != 0) & ((side[s:] != 1) | (side[:-s] != 1)))
        if len(i):
            i = i[linked(fp[i] ^ fp[i + s])]
            a.append(fp[i])
            b.append(fp[i + s])
    for k, n in zip(start[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        f, s = fp[k : k + n], side[k : k + n]
        x, y = forest(f[s != 1], f[s != 0])
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different fingerprints fp that have the components of all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int8))
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            key, fp, side = (np.concatenate([r, n]) for r, n in zip(rest, (new[0], new[1].view(np.uint64), new[2].astype(np.int8)), strict=True))
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last list may go on in the next batch
            rest = key[whole:], fp[whole:], side[whole:]
            x, y = list_links(key[:whole], fp[:whole], side[:whole])
            yield record(LINKS, x.view(np.int64), y.view(np.int64))
        x, y = list_links(*rest)
        yield record(LINKS, x.view(np.int64), y.view(np.int64))

    byte = lambda p: F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(n << 24) + F.shiftleft(byte(t[0]), 16) + F.shiftleft(byte(t[1]), 8) + byte(t[2]) for n, t in enumerate(LISTS)]
    index = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    long_lists = index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = index.join(cut(long_lists), "key", "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
    pair = lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j"), F.when(k == F.col("mine"), 2).when(F.col("mine") < k, 0).otherwise(1).alias("side"))
    many = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)
    rows = dealt.select("fp", "key", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(many)).alias("p"))
    rows = rows.select(F.when((F.col("p.i") == 0) & (F.col("p.j") == 0), F.col("key")).otherwise(F.xxhash64("key", "p.i", "p.j")).alias("k"), "fp", "p.side")
    return map_arrow(rows.repartition("k").sortWithinPartitions("k", "fp"), run, "a long, b long")


def classes(rows: DataFrame) -> DataFrame:
    """(fp, component, least): for each fingerprint of rows (doc_id, tk, fp), its component's name and its least (doc_id, tk), null ids last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk")).alias("least")
    prints = cut(rows.groupBy("fp").agg(first))
    groups = cut(connected_components(links(prints.select("fp"))))
    named = prints.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut(named)
    best = cut(named.groupBy("component").agg(F.min("least").alias("least")))
    return named.select("fp", "component").join(best, "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each document."""
    rows = cut(fingerprints(docs))
    named = cut(classes(rows).select("fp", F.col("least.doc_id").alias("component_id")))
    return rows.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_named(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The documents that named (doc_id, tk, copies, first_id, first_tk; one row for each (doc_id, tk)) has as the first of their group.

    Texts are not shuffled while the rows to drop can be broadcast; only rows that are repeated whole are numbered, of which
    a task sends one each.
    """
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & F.col("tk").eqNullSafe(F.col("first_tk"))
    drops = cut(named.filter(~first | (F.col("copies") > 1)).select("doc_id", "tk", first.alias("first")))
    out = without_rows(docs, drops.select("doc_id", "tk"))
    again = drops.filter("first").select("doc_id", "tk")
    if again.isEmpty():
        return out
    i, t, k, n = free_names(docs, "_again_id", "_again_text", "_text_key", "_nth")
    tagged, again = docs.withColumn(k, text_key()), again.toDF(i, t)
    found = tagged.join(again, tagged["doc_id"].eqNullSafe(again[i]) & tagged[k].eqNullSafe(again[t]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", k).orderBy("doc_id"))
    return out.union(found.withColumn(n, nth).filter(F.col(n) == 1).select(*docs.columns))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least doc_id; repeated rows are reduced to one.

    The rows to drop are found from ids and fingerprints alone.
    """
    rows = cut(fingerprints(docs).groupBy("doc_id", "tk").agg(F.first("fp").alias("fp"), F.count("*").alias("copies")))
    return keep_named(docs, rows.join(cut(classes(rows).select("fp", "least.doc_id", "least.tk").toDF("fp", "first_id", "first_tk")), "fp"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
