"""Column functions of injected domain libraries.

None of these libraries is bundled. A provider takes one value and gives one; what it raises
becomes a null or an error text, never a lost row. Apply these to distinct values only
(``operators.distinct.map_distinct``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _safe(provider: Callable, x):
    try:
        return None if x is None else provider(x)
    except Exception:
        return None


def canonical(provider: Callable[[str], str]) -> Callable[[Column], Column]:
    """A structure's canonical text; null for missing and invalid ones."""

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([_safe(provider, v) for v in x], dtype=object)

    return run


def scaffold(provider: Callable[[str], str]) -> Callable[[Column], Column]:
    """A structure's scaffold, empty where it has none; null for missing and invalid structures."""
    return canonical(lambda v: provider(v) or "")


FINGERPRINT = T.StructType([T.StructField("fingerprint", T.ArrayType(T.ByteType())), T.StructField("error", T.StringType())])


def fingerprint(provider: Callable[[str], list[int]], bits: int = 1024) -> Callable[[Column], Column]:
    """struct(fingerprint, error): bits as 0/1 bytes, or why there are none."""

    @F.pandas_udf(FINGERPRINT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for v in x:
                try:
                    out = [int(b) for b in provider(v)]
                    rows.append((out, None) if len(out) == bits else (None, f"{len(out)} bits"))
                except Exception as e:
                    rows.append((None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["fingerprint", "error"])

    return run


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 128) -> Callable[[Column], Column]:
    """Vectors of texts from a model that each task loads once and calls on at most ``batch`` texts at a time; null for null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for x in batches:
            have = [i for i, v in enumerate(x) if v is not None]
            out: list = [None] * len(x)
            for k in range(0, len(have), batch):
                part = have[k : k + batch]
                for i, vec in zip(part, model([x.iloc[i] for i in part]), strict=True):
                    out[i] = vec
            yield pd.Series(out, dtype=object)

    return run


def features(mode: str, ligand: str = "ligand_vec", protein: str = "protein_vec") -> Column:
    """The vector that a model sees: ligand, protein, or concat."""
    return {"ligand": F.col(ligand), "protein": F.col(protein), "concat": F.concat(ligand, protein)}[mode]
