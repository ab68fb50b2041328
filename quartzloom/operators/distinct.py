"""Expensive functions evaluated once for each different input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_distinct(df: DataFrame, column: str, function: Callable[[Column], Column], name: str) -> DataFrame:
    """df with name = function(column), computed on distinct values only and joined back; null stays null."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn(name, function(F.col(column)))
    return df.join(values, column, "left")


def injected(provider: Callable, returns: str) -> Callable[[Column], Column]:
    """A column function from a provider of whole batches (list to list), such as a canonicaliser, scaffold, fingerprint or embedder.

    Domain libraries are not bundled: a provider is handed in, and its absence is an error.
    """
    if provider is None:
        raise ValueError("a provider is required")

    @F.pandas_udf(returns)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(provider(x.tolist()))

    return run


def with_model(load: Callable[[], object], apply: Callable[[object, list], list], returns: str) -> Callable[[Column], Column]:
    """A column function of a model that each task loads once: load() gives it, apply(model, batch) a value for each input."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for x in batches:
            yield pd.Series(apply(model, x.tolist()))

    return run

def missing_only(df: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows whose result does not exist yet."""
    return df.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def grouped(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], dict | None], schema: str) -> DataFrame:
    """One row for each group: the keys, the columns of schema as work gives them, and a status (success, empty, or the error).

    For groups that fit a worker, such as a protein's mutations.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: pdf[k].iloc[0] for k in keys}
        try:
            out = work(pdf)
            row |= {n: (out or {}).get(n) for n in names} | {"status": "success" if out else "empty"}
        except Exception as e:
            row |= dict.fromkeys(names) | {"status": f"error: {e}"}
        return pd.DataFrame([row], columns=[*keys, *names, "status"])

    return df.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), schema, "status string"]))
