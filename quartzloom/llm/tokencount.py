"""Token counts through a digest cache.

The cache is a table (digest, version, n_tokens): the SHA-256 of a text's normalised content, and
that of the tokenizer file. Digests are joined to it before any text is moved; each different text
that is missing is encoded once, where it is read (see ``store.unseen``), and its count is
appended. ``TokenCache`` keeps the table in a shared folder, batch by batch. Content is normalised
by reading null as empty; it is otherwise kept exactly, as any change could change the count.

Defined cases: null texts count as empty; texts of any length are encoded whole; repeated texts
share a count; ids may be null, repeated and of any type; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzloom.llm.common import by_rows, cut, map_arrow, record
from quartzloom.llm.store import BatchTable, content, digest, unseen

FILE, LIMIT = "byte_bpe_50k.json", 512
CACHE = "digest binary, version string, n_tokens long"


@lru_cache
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """The library of the file: tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def version_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def encode_misses(docs: DataFrame, file: str = FILE, cache: DataFrame | None = None) -> DataFrame:
    """The rows to append to the cache: one for each different text that it lacks. file: a name in the tokenizers' folder, or a path."""
    version = version_of(public_tokenizers.path(file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, out = counter(public_tokenizers.path(file)), pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
        for part in by_rows(batches, 64):
            yield record(out, part.column(0), count(part.column(1).to_pylist()))

    seen = None if cache is None else cache.select("digest", F.array("version").alias("done"))
    texts = unseen(docs, [version], seen).select("digest", "text")
    counted = map_arrow(texts, run, "digest binary, n_tokens long").groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    return counted.select("digest", F.lit(version).alias("version"), "n_tokens")


def with_counts(docs: DataFrame, cache: DataFrame, file: str = FILE, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row whose text the cache has."""
    rows = docs.select("doc_id", digest().alias("digest"), F.octet_length(content()).cast("long").alias("n_bytes"))
    out = rows.join(cache.filter(F.col("version") == version_of(public_tokenizers.path(file))).select("digest", "n_tokens"), "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_tokens(docs: DataFrame, file: str = FILE, cache: DataFrame | None = None, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """with_counts() for all rows, and the cache with the new counts appended."""
    new = cut(encode_misses(docs, file, cache))
    known = new if cache is None else cache.select("digest", "version", "n_tokens").union(new)
    return with_counts(docs, known, file, limit), known


class TokenCache:
    """A durable cache: batches of counts in a shared folder, of any tokenizer versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = BatchTable(spark, path, CACHE)

    def count(self, batch: str, docs: DataFrame, file: str = FILE, limit: int = LIMIT) -> DataFrame:
        """Encode and append what is missing, and return with_counts(). A batch that failed is completed by calling this again."""
        self.table.append(batch, encode_misses(docs, file, self.table.read()))
        return with_counts(docs, self.table.read(), file, limit)


def op8_tokencount(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
