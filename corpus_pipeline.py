"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` applies
them to the table documents; between stages the rows are written as Parquet to the folder that the
executors share, and read again. The ledger of the quality stage is kept where ``run`` is told to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quartzloom.llm import decontam, linededup, packing, quality, resemblance
from quartzloom.llm.common import new_path, remove, scratch, store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """Documents that the production policy rejects go. The ledger stays in a folder of that name, for ``quality.keep_by`` with other policies."""
    return quality.keep_good(docs, path=ledger)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them."""
    return linededup.drop_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by operator 3's links at 3 bits and by five-word Jaccard of 0.8 or more, the document with the least doc_id stays."""
    return resemblance.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, packed into sequences of token ids."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("packing", packing_stage)]

#: Fingerprints and token ids cannot be had in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """ledger: a folder that the executors share, for the quality ledger; None: it goes with the stage's own tables."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):  # what the stage wrote for itself goes once its result is written
            kept = stage(spark, docs, sf_dir, ledger) if stage is quality_stage else stage(spark, docs, sf_dir)
            docs = store(kept, path)
        if last:
            remove(spark, last)
        last = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # packing has written its pieces by now and reads the documents no more
    remove(spark, last)
    return out
