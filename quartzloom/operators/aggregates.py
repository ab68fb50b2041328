"""Aggregations with the semantics that the pipelines rely on."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_std(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """<c>_mean and <c>_std (sample; 0 for one row), without rows of a null key."""
    aggs = [a for c in cols for a in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))]
    return df.dropna(subset=keys).groupBy(*keys).agg(*aggs)


def mode(c: str | Column) -> Column:
    """The most frequent value; of equals the least."""
    return F.mode(c, True)


def first_by(df: DataFrame, keys: list[str], order: list, cols: list[str] | None = None) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
    return out.select(*keys, *cols) if cols else out


def first_present(value: str, *order: str) -> Column:
    """Aggregate: the value of the first row that has one."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct(*order, value)))[value]


def without_sentinel(c: str, sentinel: float = -1) -> Column:
    """Mean of the values that are not the sentinel."""
    return F.avg(F.when(F.col(c) != sentinel, F.col(c)))


def share_true(c: str | Column) -> Column:
    return F.avg((F.col(c) if isinstance(c, str) else c).cast("int"))


def distinct_histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """(n, count): keys by their number of distinct values, ascending."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n")).groupBy("n").agg(F.count("*").alias("count")).orderBy("n")


def value_shares(df: DataFrame, c: str) -> DataFrame:
    """(c, count, share): the total comes from the counts, not from the rows again."""
    counts = df.groupBy(c).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.join(F.broadcast(total)).select(c, "count", (F.col("count") / F.col("_t")).alias("share"))


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation over rows with both values; null where either does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    sd = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(sd > 0, F.try_divide(F.covar_pop(a, b), sd))


def correlations(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """(feature, r), descending; features without a correlation come last."""
    row = df.agg(*(safe_corr(target, c).alias(c) for c in cols))
    return row.unpivot([], cols, "feature", "r").orderBy(F.desc_nulls_last("r"), "feature")


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(n, mean, m2) of batches merged into the mean and population variance of all, in any order.

    The mean of all comes first and is joined back to the batches, one row a key: differences from it do not cancel,
    however large the means are. Batches of no rows change nothing.
    """
    parts = parts.filter(F.col("n") > 0)
    total = parts.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_rough"))
    back = total.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys)) if keys else F.lit(True)
    off = F.col("mean") - F.col("_rough")
    n, shift = F.sum("n"), F.sum(F.col("n") * off) / F.sum("n")
    var = (F.sum("m2") + F.sum(F.col("n") * off * off)) / n - shift * shift
    return parts.join(back, same).groupBy(*keys).agg(n.alias("n"), (F.max("_rough") + shift).alias("mean"), F.greatest(var, F.lit(0.0)).alias("var"))


def vector_sum(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise sums of arrays by key, in one pass. Arrays have equal lengths and no missing element; missing arrays are left out."""
    rows = df.filter(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(vector))
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias(vector))


def vector_moments_by(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(*keys, mean, std): arrays by key, population std, in one pass."""
    rows = df.filter(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(vector))
    one = rows.groupBy(*keys).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).filter("s.count > 0")
    n = F.col("s.count")
    return one.select(*keys, vector_to_array("s.mean").alias("mean"), F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n)).alias("std"))


def vector_moments(df: DataFrame, vector: str) -> DataFrame:
    """(mean, std): one row of arrays; none for a table without vectors."""
    return vector_moments_by(df, [], vector)


def column_stats(df: DataFrame, vector: str) -> DataFrame:
    """(dim, mean, std) of each place of an array column, population std."""
    return vector_moments(df, vector).select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "s")).select("dim", "s.mean", "s.std")


def range_of(df: DataFrame, value: str, ranges: int = 64) -> Column:
    """The number of a value's range, of at most so many whose bounds are quantiles read beforehand; order is kept."""
    bounds = sorted({float(b) for b in df.select(F.col(value).cast("double").alias("s")).approxQuantile("s", [i / ranges for i in range(1, ranges)], 0.005)})
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value))) if bounds else F.lit(0)


def auc(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Exact ROC AUC by mid-ranks; null with one class only. Scores are counted first, so ties shrink the sort.

    Positives are ranked against negatives by running counts in two levels: over ranges of scores, then within each
    range, so no task holds all scores.
    """
    keys = keys or []
    counts = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("q"))
    dealt = counts.withColumn("_part", range_of(counts, score))
    before = Window.partitionBy(*keys, "_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("q").alias("_q"))
    parts = parts.withColumn("_below", F.coalesce(F.sum("_q").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_q")
    rows = dealt.withColumn("_in", F.coalesce(F.sum("q").over(before), F.lit(0))).join(parts, [*keys, "_part"])
    wins = F.sum(F.col("p") * (F.col("_below") + F.col("_in") + F.col("q") / 2))
    return rows.groupBy(*keys).agg(F.try_divide(wins, F.sum("p") * F.sum("q")).alias("auc"))


#: Rows of a key up to which one task may hold its distinct values, about 24 bytes each; accuracy of the sketch that places bounds for larger keys.
HELD_ROWS, ACCURACY = 200_000, 1000


def quantiles(df: DataFrame, keys: list[str], value: str, held: int = HELD_ROWS, **ps: float) -> DataFrame:
    """(*keys, name...): exact quantiles by key, interpolated, named by ps. Missing values do not count; a key without any has null; NaN is the largest value.

    Rows are counted by key first, in the same job: nothing runs before the result is asked for. Keys of up to ``held``
    values are aggregated at once. For larger keys, of which there is at most one in ``held`` rows (so they are broadcast),
    a sketch places bounds closely around the wanted ranks; one pass counts the values between bounds, which finds the
    ranges of the ranks exactly, wherever the bounds are; another counts and ranks the values of these ranges alone. Rows
    of large keys do not move, and a task ranks about 0.4 % of a key's values for each quantile, counted by value.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    named = {x: f"_of_{x}" for x in keys}
    same = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(named[x])) for x in keys), F.lit(True))
    large = F.broadcast(rows.groupBy(*keys).agg(F.count("_v").alias("_n")).filter(F.col("_n") > held).withColumnsRenamed(named))
    small = rows.join(large, same, "left_anti").groupBy(*keys).agg(*(F.percentile("_v", F.lit(float(p))).alias(n) for n, p in ps.items()))
    near = sorted({min(max(p + side * 2 / ACCURACY, 0.0), 1.0) for p in ps.values() for side in (-1, 1)})
    bounds = F.percentile_approx("_v", F.expr(f"array({', '.join(f'{x!r}D' for x in near)})"), F.lit(ACCURACY))
    there = rows.filter("_v is not null")
    sketched = there.join(large, same).groupBy(*keys, "_n").agg(F.array_sort(F.array_distinct(bounds)).alias("_bounds"))

    rank = {n: (F.col("_n") - 1) * F.lit(float(p)) for n, p in ps.items()}
    places = {f"_{side}_{n}": cut(rank[n]) for n in ps for side, cut in (("low", F.floor), ("high", F.ceil))}
    found = ranked_in_ranges(there, sketched, keys, places)

    def between(n: str) -> Column:
        low, high = F.col(f"_low_{n}"), F.col(f"_high_{n}")
        return F.when(low == high, low).otherwise((F.ceil(rank[n]) - rank[n]) * low + (rank[n] - F.floor(rank[n])) * high).alias(n)

    return small.unionByName(found.select(*keys, *(between(n) for n in ps)))


def ranked_in_ranges(rows: DataFrame, large: DataFrame, keys: list[str], places: dict[str, Column]) -> DataFrame:
    """(*keys, _n, place...): the values at places (from 0) of the ordered values of the large keys.

    rows: (*keys, _v), no value null. large: (*keys, _n, _bounds); bounds cut the values into ranges, and need not be right.
    They depend on the order in which a sketch was merged, so the third pass takes ranges by their ends from the second,
    never from a second sketch. Should lost tasks bring other bounds into the second pass, its counts do not add up, and
    it fails rather than err.
    """
    named = {x: f"_of_{x}" for x in keys}
    same = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(named[x])) for x in keys), F.lit(True))
    part = F.size(F.filter("_bounds", lambda b: b < F.col("_v"))).alias("_part")
    dealt = rows.join(F.broadcast(large.withColumnsRenamed(named)), same).select(*keys, "_n", "_bounds", part)
    parts = dealt.groupBy(*keys, "_n", "_bounds", "_part").agg(F.count("*").alias("_k"))
    of_key = Window.partitionBy(*keys, "_bounds")
    before = F.coalesce(F.sum("_k").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sound = F.when(F.sum("_k").over(of_key) == F.col("_n"), before).otherwise(F.raise_error(F.lit("bounds of quantiles changed while they were read")).cast("long"))
    ends = {"_above": F.get("_bounds", F.col("_part") - 1), "_until": F.get("_bounds", F.col("_part"))}
    parts = parts.withColumn("_before", sound).withColumns(ends)
    wanted = parts.filter(reduce(lambda a, b: a | b, ((i >= F.col("_before")) & (i < F.col("_before") + F.col("_k")) for i in places.values()))).drop("_k", "_bounds")
    inside = F.coalesce(F.col("_v") > F.col("_above"), F.lit(True)) & F.coalesce(F.col("_v") <= F.col("_until"), F.lit(True))
    counts = rows.join(F.broadcast(wanted.withColumnsRenamed(named)), same & inside).groupBy(*keys, "_n", "_part", "_before", "_v").agg(F.count("*").alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    hit = lambda i: F.max(F.when((i < F.col("_upto")) & (i >= F.col("_upto") - F.col("_c")), F.col("_v")))
    return counts.withColumn("_upto", upto).groupBy(*keys, "_n").agg(*(hit(i).alias(c) for c, i in places.items()))


def accuracy(label: str, predicted: str) -> Column:
    return F.avg((F.col(label) == F.col(predicted)).cast("int"))


def t_statistic(df: DataFrame, keys: list[str], value: str, mean0: float = 0.5) -> DataFrame:
    """(n, mean, t, df) of a one-sample test; without spread t is infinite above mean0, else 0."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    sem = F.col("_s") / F.sqrt(F.col("n").cast("double"))
    flat = F.when(F.col("mean") > mean0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return g.withColumns({"t": F.when(sem > 0, F.try_divide(F.col("mean") - mean0, sem)).otherwise(flat), "df": F.col("n") - 1}).drop("_s")


def split_stats(df: DataFrame, split: str, group: str, label: str) -> DataFrame:
    """Rows, distinct groups and the share of label 1 in per cent, by split."""
    return df.groupBy(split).agg(F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups"), F.sum(F.col(label).cast("long")).alias("n_positive"), (100 * F.avg(F.col(label).cast("double"))).alias("pct_positive"))


def counters(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("count"))


def axis_limit(df: DataFrame, keys: list[str], value: str, floor: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.greatest(F.max(value), F.lit(floor)).alias("limit"))
