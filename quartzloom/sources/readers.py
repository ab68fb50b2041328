"""Sources: delimited text, Parquet, SQL, index and block text, logs, archives, external programs."""

from __future__ import annotations

import io
import json
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzloom.functions.sequences import fasta_sequence, key_value
from quartzloom.session import cut


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header. Give a schema for large files: inference reads them twice."""
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)


def read_tsv(spark: SparkSession, path: str, columns: list[str], quoted: bool = False) -> DataFrame:
    """Chosen columns as text, by name. Not quoted: quotes are ordinary characters. Bad lines are read as far as they go."""
    reader = spark.read.option("sep", "\t").option("header", True).option("mode", "PERMISSIVE")
    return (reader if quoted else reader.option("quote", "")).csv(path).select(*(F.col(f"`{c}`") for c in columns))


def read_parquets(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV, by the extension."""
    return spark.read.parquet(path) if path.rstrip("/").endswith((".parquet", ".pq")) else read_csv(spark, path)


def read_lake(spark: SparkSession, path: str, form: str = "parquet", not_null: list[str] | None = None) -> DataFrame:
    """A lake table in any format that the session knows; filters and columns reach the scan."""
    df = spark.read.format(form).load(path)
    return df.dropna(subset=not_null) if not_null else df


#: Named statements over registered views or a JDBC source.
STATEMENTS = {
    "relations": "SELECT tid, related_tid FROM target_relations WHERE relationship = 'SUBSET OF'",
    "activities": "SELECT assay_id, molregno, standard_value FROM activities WHERE standard_units = 'nM' AND standard_value IS NOT NULL",
    "assays": "SELECT assay_id, tid, variant_id FROM assays",
    "structures": "SELECT molregno, standard_inchi_key, canonical_smiles FROM compound_structures",
    "components": "SELECT tid, component_id FROM target_components",
    "sequences": "SELECT component_id, sequence, accession FROM component_sequences",
    "variants": "SELECT variant_id, sequence FROM variant_sequences",
}


def sql_scan(spark: SparkSession, name: str, url: str | None = None, **options: str) -> DataFrame:
    """A named statement, on views or pushed to a database."""
    if url is None:
        return spark.sql(STATEMENTS[name])
    return spark.read.format("jdbc").options(url=url, query=STATEMENTS[name], **options).load()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, key): the first and third of at least three tokens of each line; lines that begin with # are comments."""
    tokens = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(~F.col("value").startswith("#")).withColumn("t", tokens).filter(F.size("t") >= 3)
    return lines.select(F.col("t")[0].alias("id"), F.col("t")[2].alias("key"))


def parse_blocks(df: DataFrame, text: str = "value", mark: str = "Pocket", keys: list[str] | None = None) -> DataFrame:
    """Blocks that begin with a mark, their 'key : value' lines as columns k (or as a map if keys is None).

    One row a block, with its number from 1; values are numbers in ``numbers`` where they are, texts in ``texts`` otherwise.
    """
    blocks = df.select(*df.columns, F.posexplode(F.split(text, mark)).alias("block", "_b")).filter("block > 0")
    lines = F.filter(F.transform(F.split("_b", "\n"), key_value), lambda x: x.isNotNull() & (x["text"] != ""))
    distinct = F.map_from_entries(F.aggregate(lines, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, x: F.array_append(F.filter(acc, lambda y: y["k"] != x["key"]), F.struct(x["key"].alias("k"), x["text"].alias("v")))))
    out = blocks.withColumn("texts", distinct).drop("_b", text)
    if keys is None:
        return out
    from quartzloom.operators.clean import to_number

    return out.withColumns({k: to_number(F.try_element_at("texts", F.lit(k))) for k in keys}).drop("texts")


RUN_LOG = "epoch int, loss double, physical_potential double, kl_divergence double, participation_ratio double, cv_val double, bias_energy double, validation_accuracy double, validation_auc double, train_accuracy double, train_auc double"


def read_run_logs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Logs of a folder, one file a run: the run's name is the file's. Lines that begin with # are comments."""
    df = spark.read.csv(path, header=True, comment="#", schema=schema, inferSchema=schema is None, enforceSchema=False) if schema else spark.read.csv(path, header=True, comment="#", inferSchema=True)
    return df.withColumn("run_name", F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def list_files(spark: SparkSession, path: str, suffix: str = ".csv", folders: bool = False) -> DataFrame:
    """(name) of files with a suffix, or of folders, sorted; through the file system of the path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    names = sorted(f.getPath().getName() for f in found if (f.isDirectory() if folders else f.isFile() and f.getPath().getName().endswith(suffix)))
    return spark.createDataFrame([(n,) for n in names], "name string")


def read_tasks(spark: SparkSession, path: str, **constants: object) -> DataFrame:
    """A task list with constant columns."""
    return read_csv(spark, path).withColumns({k: F.lit(v) for k, v in constants.items()})


@dataclass
class SplitConfig:
    hierarchy_levels: list[int]
    n_folds: int = 5
    n_stochastic_splits: int = 1
    max_actives_per_target: int | float | None = None
    max_test_actives_per_target: int | float | None = None


def read_config(path: str) -> list[SplitConfig]:
    """A JSON array of split settings; other keys are ignored."""
    known = SplitConfig.__dataclass_fields__
    return [SplitConfig(**{k: v for k, v in c.items() if k in known}) for c in json.loads(Path(path).read_text())]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, vec) of keyed vector archives (.npz), each file read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content)) as z:
                    yield pd.DataFrame({"target_id": list(z.files), "vec": [np.asarray(z[k], np.float32).ravel() for k in z.files]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "target_id string, vec array<float>")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, sequence): a record a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), fasta_sequence(F.col("value")).alias("sequence"))


def fetch(df: DataFrame, provider: Callable[[str], object], column: str, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """df with payload (JSON) and status from a provider of remote records, tried again with growing pauses. Each distinct key is asked once."""
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch[column]:
                payload, status = None, "ok"
                for n in range(tries):
                    try:
                        payload, status = json.dumps(provider(key)), "ok"
                        break
                    except Exception as e:
                        status = f"error: {e}"
                        if n + 1 < tries:
                            time.sleep(wait * 2**n)
                rows.append((key, payload, status))
            yield pd.DataFrame(rows, columns=[column, "payload", "status"])

    keys = df.select(F.col(column).cast("string").alias(column)).filter(F.col(column).isNotNull()).distinct()
    return df.join(keys.mapInPandas(run, f"{column} string, payload string, status string"), column, "left")


def run_program(df: DataFrame, command: Callable[[str], list[str]], column: str, timeout: float = 300, cache: str | None = None) -> DataFrame:
    """(column, output, status) of an external program for each key: success, timeout, missing, or failed with its message.

    cache: a Parquet folder of earlier outputs. Keys that it has are not run and have the status cached; new successes
    are appended to it, once, before the result is returned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch[column]:
                try:
                    done = subprocess.run(command(key), capture_output=True, text=True, timeout=timeout)
                    rows.append((key, done.stdout, "success" if done.returncode == 0 else f"failed: {done.stderr[-200:]}"))
                except subprocess.TimeoutExpired:
                    rows.append((key, None, "timeout"))
                except FileNotFoundError:
                    rows.append((key, None, "missing"))
            yield pd.DataFrame(rows, columns=[column, "output", "status"])

    schema, keys = f"{column} string, output string, status string", df.select(F.col(column).cast("string").alias(column))
    if cache is None:
        return keys.mapInPandas(run, schema)
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    keys = keys.filter(F.col(column).isNotNull()).distinct()
    held = cut(spark.read.parquet(cache).select(column, "output").dropDuplicates([column])) if there else spark.createDataFrame([], f"{column} string, output string")
    new = cut(keys.join(held, column, "left_anti").mapInPandas(run, schema))
    new.filter("status = 'success'").select(column, "output").write.mode("append").parquet(cache)
    return keys.join(held, column).select(column, "output", F.lit("cached").alias("status")).union(new)


def cached_files(spark: SparkSession, folder: str, keys: list[str], patterns: tuple[str, ...] = ("{}.pdb", "pdb{}.ent")) -> DataFrame:
    """(key, name, content) of files of a cache folder: for each key the file under the first of several name patterns that exists. Keys without any are absent."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = spark.createDataFrame([(k, i, p.format(k)) for k in keys for i, p in enumerate(patterns)], "key string, _nth int, name string")
    found = files.select(name.alias("name")).join(wanted, "name").groupBy("key").agg(F.min(F.struct("_nth", "name")).alias("_f")).select("key", F.col("_f.name").alias("name"))
    return files.select(name.alias("name"), "content").join(found, "name").select("key", "name", "content")
