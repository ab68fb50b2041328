"""Projections: lenient casts, text cleaners, consolidation of several measurements, labels and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a number. Spark's own cast also takes '1d' and surrounding blanks.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(c: Column) -> Column:
    """Double, or null where the text is no number."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def strip_commas(c: Column) -> Column:
    """Blanks, angle brackets and dots go from both ends, commas everywhere."""
    return to_number(F.replace(F.btrim(c, F.lit(" <>.")), F.lit(","), F.lit("")))


def any_angle(c: Column) -> Column:
    """Angle brackets go wherever they are."""
    return to_number(F.translate(c, "<>", ""))


def coerce(c: Column) -> Column:
    """As any_angle, from a column of any type; a missing value stays missing."""
    return any_angle(c.cast("string"))


def first_value(*cols: Column) -> Column:
    """The first that is present, in order of priority."""
    return F.coalesce(*cols)


def row_min(*cols: Column) -> Column:
    return F.least(*cols)


def row_median(*cols: Column) -> Column:
    """The median of those present; null where none is."""
    have = F.sort_array(F.filter(F.array(*cols), lambda x: x.isNotNull()))
    n = F.size(have)
    low, high = F.get(have, ((n - 1) / 2).cast("int")), F.get(have, (n / 2).cast("int"))
    return (low + high) / 2


def coalesce_present(df: DataFrame, names: list[str]) -> Column:
    """The first present value of those columns that the table has."""
    return F.coalesce(*(F.col(c) for c in names if c in df.columns))


def p_scale(nanomolar: Column) -> Column:
    """9 - log10(x) for positive x, else null."""
    return F.when(nanomolar > 0, F.lit(9.0) - F.log10(nanomolar))


def with_quantile(df: DataFrame, key: str, value: str, p: float, name: str) -> DataFrame:
    """df with its key's exact quantile under a new name, which replaces a column that has it.

    Quantiles are aggregated apart and joined back: rows themselves move only where the table of keys is too large to
    broadcast, and a hot key can then be split. A window would sort each key in one task.
    """
    from quartzloom.operators.aggregates import quantiles

    q = quantiles(df.select(F.col(key).alias("_qk"), F.col(value).alias("_qv")), ["_qk"], "_qv", _q=p)
    kept = [c for c in df.columns if c != name]
    return df.join(q, F.col(key).eqNullSafe(F.col("_qk")), "left").select(*kept, F.col("_q").alias(name))


def label_by_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """threshold: the key's median; is_active: value >= threshold. Columns of these names are replaced."""
    return with_quantile(df, key, value, 0.5, "threshold").withColumn("is_active", F.col(value) >= F.col("threshold"))


def label_by_quantile(df: DataFrame, key: str, value: str, p: float = 0.5) -> DataFrame:
    """active: 1 where value < the key's quantile, else 0. A column of this name is replaced."""
    return with_quantile(df, key, value, p, "_quantile").withColumn("active", (F.col(value) < F.col("_quantile")).cast("int")).drop("_quantile")


def fold_change(wild: Column, mutant: Column) -> Column:
    """mutant / wild; infinite for a positive value over zero, null for 0/0 and missing values."""
    inf = F.when(mutant > 0, F.lit(float("inf"))).when(mutant < 0, F.lit(float("-inf")))
    return F.when(wild != 0, F.try_divide(mutant, wild)).when(wild == 0, inf)


def above(x: Column, threshold: float) -> Column:
    """1 where x > threshold, 0 elsewhere, missing and NaN included."""
    return F.coalesce((F.nanvl(x, F.lit(None).cast("double")) > threshold).cast("int"), F.lit(0))


def composite_key(*cols: Column, sep: str = "_") -> Column:
    """Null where a part is null."""
    parts = [p for c in cols for p in (F.lit(sep), c.cast("string"))][1:]
    return F.concat(*parts)


def key_head(c: Column, sep: str = "_") -> Column:
    """What stands before the first separator."""
    return F.substring_index(c, sep, 1)


def path_columns(df: DataFrame, path: str, levels: range, sep: str = ";") -> DataFrame:
    """k<n>_cluster for each level; null beyond the end of a path."""
    parts = F.split(path, sep)
    return df.withColumns({f"k{k}_cluster": F.get(parts, F.lit(k - levels.start)).try_cast("int") for k in levels}).drop(path)


def rename_all(df: DataFrame, rule) -> DataFrame:
    """Columns renamed by a function of the name."""
    return df.toDF(*map(rule, df.columns))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def with_suffix(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def fill_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values replaced by the column's mean: one aggregate row, joined as a broadcast of one row."""
    means = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in cols))
    return df.join(F.broadcast(means)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in cols}).drop(*means.columns)


def decimals(c: Column, n: int = 1) -> Column:
    """Text with n decimals; halves of the shortest decimal form go up."""
    return F.format_string(f"%.{n}f", c)
