"""Gram tables of a model's training points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.functions.vectors import rbf

MOST = 5_000


def gram(df: DataFrame, gamma: float) -> DataFrame:
    """(i, j, k) for training points (id, vec). A model has MOST points at most: they travel as one array to every row."""
    if df.count() > MOST:
        raise ValueError(f"more than {MOST} training points")
    points = df.agg(F.collect_list(F.struct("id", "vec")).alias("_all"))
    rows = df.join(F.broadcast(points)).select(F.col("id").alias("i"), F.explode(F.transform("_all", lambda p: F.struct(p["id"].alias("j"), rbf(F.col("vec"), p["vec"], gamma).alias("k")))).alias("p"))
    return rows.select("i", "p.j", "p.k")
