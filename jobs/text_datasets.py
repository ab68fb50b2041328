"""Builds leak-proof train and test sets of labelled texts, a set for each target.

    python -m jobs.text_datasets --documents D --labels L --out O [--config jobs/text_datasets.json]

What the affinity pipeline does with measured structures, for texts with labels: a target is a
language, a structure a text in canonical form, a measurement a label, and a scaffold the opening
words that a text shares with its near copies and templates.

1. Documents with a label are read; null and blank texts are left out and counted.
2. Texts that are equal in canonical form (A-Z lower-cased, white space collapsed) in a language are one row: the least
   doc_id and its text, the number of copies, and the median of all their labels. Such a row is positive above ``positive``.
3. ``max_per_target`` rows of a language are kept by draw; all, unless it is set.
4. Scaffolds go whole to one side, the smallest first to test until it has ``test_size`` of the rows.
5. Rows are written as Parquet, partitioned by lang and side, under O/rows, and the counts of each lang and side as JSON
   under O/summary. A run replaces both, so that it may be run again at any time; no scaffold of a language is on
   two sides, which is checked before anything is written.

Documents of a null lang are a target of their own. Of several labels of a document each counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import checked, command, log, observed
from quartzloom.operators import aggregates, clean, filters, splits

DEFAULTS = {"test_size": 0.2, "opening_words": 5, "positive": 0.5, "max_per_target": None, "seed": 42}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: str) -> Column:
    return F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[\\x09-\\x0D\\x20]+", " "))


def opening(text: Column, words: int) -> Column:
    return F.md5(F.substring_index(text, " ", words))


def measured_texts(documents: DataFrame, labels: DataFrame, positive: float, words: int) -> tuple[DataFrame, Observation]:
    """A row for each different text of a language that has a label; the observation counts labelled rows and those removed as blank."""
    marks = labels.filter("quality is not null").select("doc_id", "quality")
    rows = documents.select("doc_id", "lang", "source", "text").join(marks, "doc_id").withColumn("canonical", canonical("text"))
    rows, seen = filters.non_empty(rows, "canonical")
    first = F.min_by(F.struct("source", "text", "canonical"), "doc_id")
    one = rows.groupBy("lang", F.sha2("canonical", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), first.alias("f"), F.median("quality").alias("activity"), F.countDistinct("doc_id").alias("copies"))
    out = one.select("doc_id", "lang", "f.source", "f.text", "copies", "activity", clean.above(F.col("activity"), positive).alias("label"), opening(F.col("f.canonical"), words).alias("scaffold"))
    return out, seen


def build(spark: SparkSession, documents: str, labels: str, out: str, config: dict | None = None) -> dict[str, int]:
    """Reads, splits, writes; returns the counts that it logs."""
    c, say = checked(config, DEFAULTS), log("text_datasets")
    rows, seen = measured_texts(spark.read.parquet(documents), spark.read.parquet(labels), c["positive"], c["opening_words"])
    if c["max_per_target"]:
        rows = splits.sample_cap(rows, ["lang"], ["doc_id"], c["max_per_target"], c["seed"])
    sides = splits.scaffold_split(rows, "lang", "scaffold", ["doc_id"], c["test_size"])
    per = sides.groupBy("lang", "scaffold").agg(F.countDistinct("side").alias("n")).filter("n > 1")
    if not per.isEmpty():
        raise AssertionError("a scaffold is on two sides")
    written = Observation()
    sides.observe(written, F.count("*").alias("rows"), F.sum("copies").alias("documents")).write.mode("overwrite").partitionBy("lang", "side").parquet(f"{out}/rows")
    back = spark.read.schema(sides.schema).parquet(f"{out}/rows")
    counts = aggregates.split_stats(back.withColumn("_split", F.struct("lang", "side")), "_split", "scaffold", "label")
    counts.select("_split.*", "n_rows", "n_groups", "n_positive", "pct_positive").coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    told = {"read": observed(seen, "rows"), "blank": observed(seen, "removed"), "written": observed(written, "rows"), "documents": observed(written, "documents")}
    say.info("read %(read)d labelled documents, left out %(blank)d blank; wrote %(written)d texts of %(documents)d documents", told)
    return told


if __name__ == "__main__":
    command(__doc__, {"documents": "table of documents", "labels": "table of labels", "out": "folder to write"}, build, DEFAULTS)
