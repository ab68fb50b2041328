"""Joins beyond plain equi-joins: checked lookups, pairs, nearest, interval and spatial joins."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzloom.operators.aggregates import quantiles


def lookup_all(df: DataFrame, *tables: tuple[DataFrame, str]) -> DataFrame:
    """Inner joins with several dictionaries; a row missing in any of them goes."""
    return reduce(lambda left, t: left.join(t[0], t[1]), tables, df)


def checked_lookup(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Inner join; raises KeyError where a key is missing from the table."""
    missing = df.join(table, on, "left_anti").select(on).limit(1).collect()
    if missing:
        raise KeyError(missing[0][0])
    return df.join(table, on)


def optional_join(df: DataFrame, table: DataFrame | None, on: str) -> DataFrame:
    return df if table is None else df.join(table, on)


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of parameter values. The lists are literals of a sweep, not tables."""
    return spark.createDataFrame([tuple(x) for x in product(*values.values())], list(values))


def mutant_wild_pairs(mutant: DataFrame, wild: DataFrame, keys: list[str], value: str, aggregate: bool = True) -> DataFrame:
    """mutant rows with wt_value: the wild-type median per key, or each wild-type row (many to many) if not aggregated."""
    wt = quantiles(wild, keys, value, wt_value=0.5) if aggregate else wild.select(*keys, F.col(value).alias("wt_value"))
    return mutant.join(wt, keys)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(points: DataFrame, centres: DataFrame, point_id: str, vector: str = "vec") -> DataFrame:
    """For each centre (centre_id, centre) its nearest point; ties go to the least id.

    The centres are cluster centres: their number is a parameter of the clustering. They travel as one array, so every
    point is read once and gives one row per centre to a map-side minimum.
    """
    all_ = centres.agg(F.collect_list(F.struct("centre_id", "centre")).alias("cs"))
    rows = points.join(F.broadcast(all_)).select(point_id, F.explode(F.transform("cs", lambda c: F.struct(c["centre_id"].alias("centre_id"), squared_distance(F.col(vector), c["centre"]).alias("d")))).alias("x"))
    best = rows.groupBy("x.centre_id").agg(F.min(F.struct("x.d", F.col(point_id))).alias("m"))
    return best.select("centre_id", F.col(f"m.{point_id}").alias(point_id), F.col("m.d").alias("distance2"))


def map_offsets(exons: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """Coding offsets to genome positions.

    exons (key, start, end, strand), offsets (key, offset from 0): exons are walked by start, backwards on strand -1; an
    offset lies in the exon whose running length first passes it. Offsets beyond the last exon give no row.
    """
    length = F.col("end") - F.col("start") + 1
    w = Window.partitionBy(key).orderBy(F.col("start") * F.col("strand"))
    walked = exons.withColumn("hi", F.sum(length).over(w)).withColumn("lo", F.col("hi") - length)
    hit = offsets.join(walked, key).filter((F.col("offset") >= F.col("lo")) & (F.col("offset") < F.col("hi")))
    inside = F.col("offset") - F.col("lo")
    return hit.withColumn("position", F.when(F.col("strand") > 0, F.col("start") + inside).otherwise(F.col("end") - inside)).drop("lo", "hi")


def best_match(candidates: DataFrame, key: str, score: str, ratio: Column, least: float = 0.8, tie: str = "candidate") -> DataFrame:
    """The candidate of the highest score for each key, if its ratio reaches the gate."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return candidates.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).filter(ratio >= least).drop("_r")


def within(left: DataFrame, right: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Pairs at a distance of at most radius, by an equi-join on grid cells of that width and its neighbours.

    left and right have the axes as l_<axis> and r_<axis>. Each left point meets 3^d cells only.
    """
    cell = lambda side, a: F.floor(F.col(f"{side}_{a}") / radius)
    steps = F.array(*(F.array(*map(F.lit, s)) for s in product((-1, 0, 1), repeat=len(axes))))
    lefts = left.withColumn("_s", F.explode(steps))
    for i, a in enumerate(axes):
        lefts = lefts.withColumn(f"_c{i}", cell("l", a) + F.col("_s")[i])
        right = right.withColumn(f"_c{i}", cell("r", a))
    d2 = reduce(lambda x, y: x + y, ((F.col(f"l_{a}") - F.col(f"r_{a}")) * (F.col(f"l_{a}") - F.col(f"r_{a}")) for a in axes))
    cells = [f"_c{i}" for i in range(len(axes))]
    return lefts.join(right, cells).withColumn("distance2", d2).filter(F.col("distance2") <= radius * radius).drop("_s", *cells)
