"""Functions of array columns: scaling, kernels and decision functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzloom.operators.joins import dot, squared_distance

__all__ = ["dot", "squared_distance"]


def _each(f, *cols: Column) -> Column:
    return F.zip_with(*cols, f) if len(cols) == 2 else F.transform(cols[0], f)


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std, with 1 for a std of 0."""
    centred = F.zip_with(x, mean, lambda a, m: a.cast("double") - m)
    return F.zip_with(centred, std, lambda a, s: a / F.when(s == 0, F.lit(1.0)).otherwise(s))


def zscore_inside(x: Column, mean: Column, var: Column, eps: float = 1e-7) -> Column:
    """(x - mean) / sqrt(var + eps)."""
    return F.zip_with(F.zip_with(x, mean, lambda a, m: a.cast("double") - m), var, lambda a, v: a / F.sqrt(v + eps))


def zscore_outside(x: Column, mean: Column, var: Column, eps: float = 1e-7) -> Column:
    """(x - mean) / (sqrt(var) + eps)."""
    return F.zip_with(F.zip_with(x, mean, lambda a, m: a.cast("double") - m), var, lambda a, v: a / (F.sqrt(v) + eps))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def l2(x: Column, eps: float = 1e-5) -> Column:
    """x / (|x| + eps)."""
    return F.zip_with(x, F.array_repeat(norm(x) + eps, F.size(x)), lambda a, n: a.cast("double") / n)


def l2_floor(x: Column, least: float = 1e-12) -> Column:
    """x / sqrt(max(|x|^2, least))."""
    return F.zip_with(x, F.array_repeat(F.sqrt(F.greatest(dot(x, x), F.lit(least))), F.size(x)), lambda a, n: a.cast("double") / n)


def nan_to_zero(x: Column) -> Column:
    return F.transform(x, lambda a: F.coalesce(F.nanvl(a.cast("double"), F.lit(0.0)), F.lit(0.0)))


def concat(*x: Column) -> Column:
    return F.concat(*x)


def delta(mutant: Column, wild: Column, kind: str = "delta") -> Column:
    """mutant - wild, null where their lengths differ; kind may also be mutant or wild."""
    if kind == "mutant":
        return mutant
    if kind == "wild":
        return wild
    return F.when(F.size(mutant) == F.size(wild), F.zip_with(mutant, wild, lambda a, b: a - b))


def mean_pool(tokens: Column, mask: Column | None = None) -> Column:
    """Mean over the token axis of array<array>, of those under the mask if one is given; a length of 0 divides by 1."""
    kept = tokens if mask is None else F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda p: p["m"] != 0), lambda p: p["t"])
    n = F.greatest(F.size(kept), F.lit(1))
    zero = F.transform(F.get(tokens, F.lit(0)), lambda _: F.lit(0.0))
    return F.transform(F.aggregate(kept, zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b.cast("double"))), lambda a: a / n)


def rbf(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-squared_distance(a, b) * gamma)


def gamma_of(df: DataFrame, vector: str, kind: str | float = "scale") -> float:
    """scale: 1 / (d var(X)) over all cells; auto: 1 / d; or the number itself."""
    if not isinstance(kind, str):
        return float(kind)
    row = df.agg(F.max(F.size(vector)).alias("d"), *((F.lit(1.0).alias("v"),) if kind == "auto" else (F.lit(None).cast("double").alias("v"),))).first()
    if kind == "auto":
        return 1.0 / row["d"]
    v = df.select(F.explode(vector).alias("x")).agg(F.var_pop(F.col("x").cast("double"))).first()[0]
    return 1.0 / (row["d"] * v) if v else 1.0


def sign_label(score: Column) -> Column:
    """-1 or 1; 1 at zero."""
    return F.when(score >= 0, F.lit(1)).otherwise(F.lit(-1))


def to_signed(label: Column) -> Column:
    """0/1 to -1/1."""
    return F.when(label > 0, F.lit(1)).otherwise(F.lit(-1))


def squash(mean: Column, var: Column) -> Column:
    """The probit-like mean of a logistic of a normal: sigma(mean / sqrt(1 + pi var / 8))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-mean / F.sqrt(F.lit(1.0) + F.pi() * var / 8)))


def participation(x: Column) -> Column:
    """(sum x)^2 / sum x^2; null if all are zero."""
    s = F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double"))
    return F.try_divide(s * s, dot(x, x))


def centred_window(start: Column, end: Column, half: int = 262144) -> Column:
    """struct(start, end) of a window round the integer midpoint."""
    mid = F.floor((start + end) / 2)
    return F.struct((mid - half).alias("start"), (mid + half).alias("end"))


def flatten_tracks(tracks: Column) -> Column:
    """A map's arrays, joined in the order of their names; empty for an empty map."""
    return F.flatten(F.transform(F.array_sort(F.map_keys(tracks)), lambda k: tracks[k]))


def pad_multiple(x: Column, k: int, fill: float = 0.0) -> Column:
    """The array with fill at its end, up to a length that k divides."""
    return F.concat(x, F.array_repeat(F.lit(fill), F.pmod(-F.size(x), F.lit(k))))


def pad_rows(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Rows of zeros added, up to a number that k divides; other columns are null there."""
    n, d = df.agg(F.count("*"), F.max(F.size(vector))).first()
    zeros = df.sparkSession.range((-n) % k).select(F.array_repeat(F.lit(0.0), int(d or 0)).cast(df.schema[vector].dataType).alias(vector))
    return df.unionByName(zeros, allowMissingColumns=True)


def linear_scores(df: DataFrame, vector: str, weights: list[float], bias: float = 0.0) -> DataFrame:
    return df.withColumn("score", dot(F.col(vector), F.array(*map(F.lit, weights))) + bias)


def kernel_scores(df: DataFrame, support: DataFrame, vector: str, kernel, bias: float = 0.0, eps: float = 1e-5) -> DataFrame:
    """sum of alpha y k(sv, x) + bias over support vectors (vec, alpha, y) with alpha > eps.

    The support vectors of a model travel as one broadcast array: their number is bounded by the model's training
    set, not by the rows scored. Each row is scored in place; no pairs are made.
    """
    kept = support.filter(F.col("alpha") > eps).agg(F.collect_list(F.struct("vec", (F.col("alpha") * F.col("y")).alias("c"))).alias("_sv"))
    total = F.aggregate("_sv", F.lit(0.0), lambda s, v: s + v["c"] * kernel(F.col(vector), v["vec"]))
    return df.join(F.broadcast(kept)).withColumn("score", total + bias).drop("_sv")
