"""Near-duplicates of the pipeline: what SimHash links, and every pair of five-word Jaccard 0.8 or more that an index finds.

Three differing bits of a 64-bit SimHash reach few of the pairs at Jaccard 0.8, where about ten bits
differ. So this stage adds an index of its own to operator 3's links. A text is a set of five-word
shingles; equal sets are one node. A node has BANDS keys, each of HASHES min-hashes: a pair at 0.8
shares one with probability 1 - (1 - 0.8^6)^16 = 0.992, more above. The nodes of a key are a list;
lists of the same nodes are compared once. Each comparison is exact, over whole sets, so that no
pair below 0.8 is linked here.

Only nodes that share a key have their sets built and moved. A list of over BLOCK nodes or
BLOCK_SHINGLES shingles is dealt as pairs of blocks to many tasks, and each writes a forest of
its links, which has the components of all links; no pairs of a group are written out. Nodes are
64-bit digests of sets: two different sets meet in one with odds of about n^2 / 2^65.

Defined cases: a null or empty text, or one of white space only, has the empty set, and all such
are one node; a text of fewer than five words has one shingle, its whole word sequence; repeated
rows are reduced to one; ids may be null and of any type that has an order; an empty table gives no
rows; other columns, whatever their names, are kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.llm import common, simhash
from quartzloom.llm.common import LOWER, by_rows, cut, free_names, id_ddl, map_arrow, new_path, record, store, text_key
from quartzloom.llm.components import connected_components

SHINGLE, BANDS, HASHES = 5, 16, 6
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
_draw = np.random.default_rng(42)
ODD, FLIP = (_draw.integers(0, 1 << 64, (BANDS * HASHES, 1), np.uint64, endpoint=False) for _ in range(2))
ODD |= np.uint64(1)
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PRINTS = pa.schema([("fp", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])


def shingles(text: str | None) -> np.ndarray:
    """The set, as sorted 64-bit numbers."""
    words = simhash.WORD.findall((text or "").translate(LOWER))
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    code = np.fromiter((digest(w, simhash.SEED) for w in words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = code[:n].copy()
    for i in range(1, size):
        out *= STEP
        out += code[i : i + n]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signed(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


def band_keys(found: np.ndarray) -> list[int]:
    """No keys for the empty set, which is one node anyway."""
    if not len(found):
        return []
    least = np.full(len(ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(least, ((found[None, i : i + 2048] ^ FLIP) * ODD).min(1), out=least)
    return [signed(xxhash.xxh64_digest(band.tobytes(), n)) for n, band in enumerate(least.reshape(BANDS, HASHES))]


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, fp, node, size, keys), a row for each row: one reading of the texts for both indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_rows(batches):
            rows = []
            for text in part.column(2).to_pylist():
                found = shingles(text)
                rows.append((simhash.fingerprint(text), signed(xxhash.xxh64_digest(found.tobytes())), len(found), band_keys(found)))
            new = record(PRINTS, *zip(*rows, strict=True)) if rows else record(PRINTS, *[[]] * len(PRINTS))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *new.columns], names=["doc_id", "tk", *PRINTS.names])

    ddl = f"{id_ddl(docs)}, tk long, fp long, node long, size long, keys array<long>"
    return map_arrow(docs.select("doc_id", text_key().alias("tk"), F.col("text").cast("string").alias("text")), run, ddl)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers: 9 common >= 4 (|a| + |b|)."""
    if len(a) > len(b):
        a, b = b, a
    if 5 * len(a) < 4 * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return 9 * int(np.count_nonzero(b[at] == a)) >= 4 * (len(a) + len(b))


def forest(members: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that have the components of all links between (side, node, set) of sides 0 and 1, or 2 and 2. A member meets each group only until it has a link there."""
    out, groups = [], []
    for side, node, found in members:
        own, rest = [(side, node, found)], []
        for group in groups:
            near = next((n for s, n, f in group if (s != side or side == 2) and (n == node or similar(f, found))), None)
            if near is None:
                rest.append(group)
            else:
                if near != node:
                    out.append((near, node))
                own, group = (group, own) if len(group) > len(own) else (own, group)
                own.extend(group)
        groups = [*rest, own]
    return out


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, found): the set of each node of wanted (node, doc_id, tk), read from the text of that row. Texts stay in place while wanted has BROADCAST_ROWS rows at most."""
    i, t, k, n = free_names(docs, "_rep_id", "_rep_text", "_text_key", "_node")
    wanted = wanted.toDF(n, i, t)
    if wanted.count() <= common.BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.withColumn(k, text_key())
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted[i]) & rows[k].eqNullSafe(wanted[t])).select(F.col(n).alias("node"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_rows(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x).tobytes() for x in part.column(1).to_pylist()], pa.binary())], names=["node", "found"])

    return map_arrow(texts, run, "node long, found binary").dropDuplicates(["node"])  # rows that are repeated whole give a set each


def jaccard_links(docs: DataFrame, nodes: DataFrame, block: int = BLOCK, volume: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) between nodes (node, size, keys, rep) of docs, those that share a key and reach 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            links = []
            for key, side, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    links += forest(members)
                    now, members = key, []
                members.append((side, node, np.frombuffer(raw, np.uint64)))
            yield record(simhash.LINKS, *(zip(*links, strict=True) if links else ([], [])))
        links = forest(members)
        yield record(simhash.LINKS, *(zip(*links, strict=True) if links else ([], [])))

    index = nodes.select("node", "size", F.explode("keys").alias("key"))
    lists = index.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("all")).filter("n > 1")
    once = lists.groupBy("n", "volume", "low", "high", "all").agg(F.min("key").alias("key"))  # the same nodes under several keys
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("volume") / volume)).cast("int")
    mine = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = index.join(cut(once.select("key", blocks.alias("blocks"))), "key").withColumn("mine", mine)
    pair = lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j"), F.when(k == F.col("mine"), 2).when(F.col("mine") < k, 0).otherwise(1).alias("side"))
    rows = dealt.select("node", "key", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("p"))
    rows = cut(rows.select(F.xxhash64("key", "p.i", "p.j").alias("k"), F.col("p.side").alias("side"), "node"))
    wanted = cut(nodes.join(rows.select("node").distinct(), "node", "left_semi").select("node", "rep.doc_id", "rep.tk"))
    whole = rows.join(sets(docs, wanted), "node").select("k", "side", "node", "found")
    return map_arrow(whole.repartition("k").sortWithinPartitions("k", "node"), run, "a long, b long")


def simhash_links(rows: DataFrame) -> DataFrame:
    """Operator 3's links, between nodes: each fingerprint stands as the least of its nodes."""
    pairs = cut(rows.select("fp", "node").distinct())
    one = cut(pairs.groupBy("fp").agg(F.min("node").alias("low"), F.max("node").alias("high")))
    same = pairs.join(one.filter("low <> high").select("fp", "low"), "fp").select(F.col("low").alias("a"), F.col("node").alias("b"))
    end = lambda name: one.select(F.col("fp").alias(name), F.col("low").alias(f"{name}_node"))
    linked = simhash.links(one.select("fp")).distinct().join(end("a"), "a").join(end("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return same.union(linked)


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component of both kinds of links, the one with the least doc_id (null ids last)."""
    read = store(prints(docs), new_path(docs.sparkSession, "prints"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk")).alias("rep")
    nodes = cut(read.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), least))
    rows = cut(read.groupBy("doc_id", "tk").agg(F.first("fp").alias("fp"), F.first("node").alias("node"), F.count("*").alias("copies")))
    groups = cut(connected_components(jaccard_links(docs, nodes).union(simhash_links(rows))))
    named = nodes.select("node", "rep").join(groups, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    named = cut(named)
    first = cut(named.groupBy("component").agg(F.min("rep").alias("first")))
    of_node = cut(named.select("node", "component").join(first, "component").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.tk").alias("first_tk")))
    return simhash.keep_named(docs, rows.join(of_node, "node"))
