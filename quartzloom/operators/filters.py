"""Row filters, gates and status routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def in_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in another table."""
    return df.join(keys.select(on), on, "left_semi")


def not_in_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where it holds, and all others (false or null)."""
    held = F.coalesce(predicate, F.lit(False))
    return df.filter(held), df.filter(~held)


def non_empty(df: DataFrame, *cols: str) -> tuple[DataFrame, Observation]:
    """Rows with a text in each column; the observation counts rows and those removed once the result has been computed."""
    seen = Observation()
    bad = ~F.lit(True)
    for c in cols:
        bad = bad | F.col(c).isNull() | (F.col(c) == "")
    watched = df.observe(seen, F.count("*").alias("rows"), F.count(F.when(bad, 1)).alias("removed"))
    return watched.filter(~bad), seen


def at_least(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of keys with n rows or more; rows without a key go."""
    return in_keys(df, df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n), key)


def varying(df: DataFrame, cols: list[str], least: float = 1e-9) -> list[str]:
    """Columns whose sample variance is above a bound: one aggregate row is read."""
    row = df.agg(*(F.var_samp(c).alias(c) for c in cols)).first()
    return [c for c in cols if row[c] is not None and row[c] > least]


def log_status(rows: Column, required: Column, least: int = 100) -> Column:
    """failed_read where a required value was never read, too_short below the least number of rows, else success."""
    return F.when(~required, "failed_read").when(rows < least, "too_short").otherwise("success")


def coding_records(records: Column, prefix: str = "ENSG", biotype: str = "protein_coding", assembly: str = "GRCh38") -> Column:
    """Records (structs with id, biotype, assembly) of the wanted kind; ids without their version."""
    kept = F.filter(records, lambda r: r["id"].startswith(prefix) & (r["biotype"] == biotype) & (r["assembly"] == assembly))
    return F.transform(kept, lambda r: F.substring_index(r["id"], ".", 1))
