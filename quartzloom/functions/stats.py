"""Statistics that Spark lacks: the survival function of Student's t."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzloom.operators.aggregates import t_statistic


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def t_survival(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    half = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t > 0 else 1 - half


@F.pandas_udf(T.DoubleType())
def t_survival_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_survival(a, b) for a, b in zip(t.astype(float), df.astype(float), strict=True)])


def one_tailed_test(df: DataFrame, keys: list[str], value: str, mean0: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """t_statistic() with p and whether it is below alpha. Groups, not rows, pass through Python."""
    out = t_statistic(df, keys, value, mean0)
    p = F.when(F.isnan("t") | (F.abs("t") == float("inf")), F.when(F.col("t") > 0, 0.0).otherwise(1.0)).otherwise(t_survival_udf(F.col("t"), F.col("df").cast("double")))
    return out.withColumn("p", p).withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))


def probability(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))
