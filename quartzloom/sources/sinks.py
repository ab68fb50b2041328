"""Sinks. All writes are distributed; names carry split and provenance."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def write_once(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Nothing is done where the path exists."""
    df.write.mode("ignore").format(form).save(path)


def write_level(df: DataFrame, folder: str, k: int, from_k: int, role: str) -> str | None:
    """k<n>[_from_k<m>]_<role>.parquet; nothing for an empty table."""
    if df.isEmpty():
        return None
    path = f"{folder}/k{k}" + (f"_from_k{from_k}" if from_k != k else "") + f"_{role}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_csv_by(df: DataFrame, path: str, *keys: str) -> None:
    """A folder for each key, every field quoted. Rows are dealt by key and a salt, so a large key has several files."""
    df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(4))).write.mode("overwrite").partitionBy(*keys).option("quoteAll", True).csv(path, header=True)


def write_paths(df: DataFrame, path: str, key: str, labels: str, sep: str = ";") -> None:
    """Hierarchy paths as text."""
    write_csv(df.select(key, F.array_join(F.col(labels).cast("array<string>"), sep).alias("hierarchy_path")), path)


def write_vectors(df: DataFrame, path: str, key: str = "target_id", vector: str = "vec") -> None:
    """The table that stands for a keyed archive."""
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_run_logs(df: DataFrame, path: str, config: str, run: str = "run", epoch: str = "epoch", parts: int | None = None) -> None:
    """A folder for each run with one text log: a comment line with the settings, the header once, then rows in epoch order.

    parts: where runs are many, so many folders part=<n> at most instead, whose log has the rows of several runs, each
    run whole and in epoch order, the run as first column. The number of files does not grow with the runs.
    In both forms an empty name is read again as null.
    """
    folder, cols = run, [c for c in df.columns if c != run]
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    if parts is not None:
        name = F.col(run).cast("string")
        quoted = F.when(name.rlike("[\r\n]"), F.raise_error(F.lit("the name of a run has a line break"))).otherwise(F.to_csv(F.struct(name), {"quoteAll": "true"}))
        folder, cols, fields = "part", [run, *cols], [F.when(name.isNull(), "").otherwise(quoted), *fields]
        df = df.withColumn(folder, F.pmod(F.xxhash64(run), F.lit(parts)).cast("int"))
    head = F.array(F.struct(F.lit(-2).cast("long").alias("n"), F.lit(f"# Config: {config}").alias("value")), F.struct(F.lit(-1).cast("long").alias("n"), F.lit(",".join(cols)).alias("value")))
    first = df.select(folder).distinct().select(folder, F.explode(head).alias("l")).select(folder, F.lit(0).alias("row"), F.lit(None).cast(df.schema[run].dataType).alias("of"), "l.n", "l.value")
    rows = df.select(folder, F.lit(1).alias("row"), F.col(run).alias("of"), F.col(epoch).cast("long").alias("n"), F.concat_ws(",", *fields).alias("value"))
    first.union(rows).repartition(folder).sortWithinPartitions(folder, "row", "of", "n").select(folder, "value").write.mode("overwrite").partitionBy(folder).text(path)


class RunLog:
    """A trainer's own log on the machine where it runs: settings as a comment line, the header once, rows written every so many."""

    def __init__(self, path: str, config: object, every: int = 100):
        self.path, self.every, self.rows, self.columns = Path(path), every, [], None
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(f"# Config: {config}\n")

    def log(self, metrics: dict, step: int) -> None:
        self.rows.append({"epoch": step, **metrics})
        if len(self.rows) >= self.every:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        with self.path.open("a") as f:
            if self.columns is None:
                self.columns = list(self.rows[0])
                f.write(",".join(self.columns) + "\n")
            f.writelines(",".join("" if r.get(c) is None else str(r[c]) for c in self.columns) + "\n" for r in self.rows)
        self.rows = []

    def finish(self) -> None:
        self.flush()


def write_chunks(df: DataFrame, path: str, chunk: str = "chunk") -> None:
    """A folder of tasks for each chunk."""
    df.repartition(chunk).write.mode("overwrite").partitionBy(chunk).csv(path, header=True)


def summary(df: DataFrame, rows: int = 20) -> str:
    """A small table as Markdown."""
    head = df.limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in head])


def save_model(df: DataFrame, path: str) -> None:
    """A model is a row of arrays; solver state is not kept."""
    df.drop("optimizer", "callback").write.mode("overwrite").parquet(path)
