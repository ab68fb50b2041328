"""Golden rows for cleaners, labels, joins and aggregates: the edge cases of the survey."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzloom.operators import aggregates as A
from quartzloom.operators import clean as C
from quartzloom.operators import filters, joins, sets
from quartzloom.operators.distinct import injected, map_distinct


def values(df, c):
    return [r[c] for r in df.orderBy("i").collect()]


def column(spark, xs, kind="string"):
    return spark.createDataFrame(list(enumerate(xs)), f"i int, x {kind}")


RAW = [">10000", "<0.5", " 1,200.5 ", "<1,000.", "", None, "n/a", "1e3", "1d", " 1.5 ", "-3"]


def test_cleaners(spark):
    df = column(spark, RAW)
    assert values(df.select("i", C.strip_commas(F.col("x")).alias("v")), "v") == [10000, 0.5, 1200.5, 1000, None, None, None, 1000, None, 1.5, -3]
    assert values(df.select("i", C.any_angle(F.col("x")).alias("v")), "v") == [10000, 0.5, None, None, None, None, None, 1000, None, None, -3]
    assert values(df.select("i", C.coerce(F.col("x")).alias("v")), "v") == [10000, 0.5, None, None, None, None, None, 1000, None, None, -3]


def test_consolidation(spark):
    rows = [(0, None, None, None, None), (1, None, 5.0, None, None), (2, 1.0, 4.0, None, 9.0), (3, 4.0, 1.0, 3.0, 2.0), (4, 0.0, -1.0, None, None)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    assert values(df.select("i", C.first_value(*cols).alias("v")), "v") == [None, 5, 1, 4, 0]
    assert values(df.select("i", C.row_min(*cols[:3]).alias("v")), "v") == [None, 5, 1, 1, -1]
    assert values(df.select("i", C.row_median(*cols).alias("v")), "v") == [None, 5, 4, 2.5, -0.5]


def test_fold_change(spark):
    df = spark.createDataFrame([(0, 0.0, 5.0), (1, 0.0, 0.0), (2, None, 1.0), (3, 2.0, 4.0), (4, 2.0, 4.1), (5, 1.0, float("nan"))], "i int, w double, m double")
    out = df.select("i", C.fold_change(F.col("w"), F.col("m")).alias("f")).withColumn("l", C.above(F.col("f"), 2.0))
    assert values(out, "l") == [1, 0, 0, 0, 1, 0]
    assert values(out, "f")[:4] == [math.inf, None, None, 2.0]


def test_labels(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0), (2, "a", 3.0), (3, "b", 7.0)], "i int, k string, v double")
    assert values(C.label_by_median(df, "k", "v"), "is_active") == [False, True, True, True]
    assert values(C.label_by_quantile(df, "k", "v"), "active") == [1, 0, 0, 0]
    clash = C.label_by_median(df.withColumns({"threshold": F.lit(9.0), "is_active": F.lit(False)}), "k", "v")
    assert sorted(clash.columns) == ["i", "is_active", "k", "threshold", "v"] and values(clash, "is_active") == [False, True, True, True]
    assert values(column(spark, [1.0, 0.0, -1.0, 1000.0], "double").select("i", C.p_scale(F.col("x")).alias("v")), "v") == [9, None, None, 6]


def test_paths_and_keys(spark):
    df = C.path_columns(column(spark, ["1;4;9", "2", None]), "x", range(2, 5))
    assert [tuple(r) for r in df.orderBy("i").collect()] == [(0, 1, 4, 9), (1, 2, None, None), (2, None, None, None)]
    k = column(spark, ["p", None]).select("i", C.composite_key(F.col("x"), F.lit("m")).alias("k"))
    assert values(k, "k") == ["p_m", None]


def test_mode_first_median(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 5), ("a", 2, 3), ("b", 0, 1), (None, 0, 9)], "k string, i int, v int")
    rows = {r["k"]: r for r in df.groupBy("k").agg(A.mode("v").alias("m"), A.first_present("v", "i").alias("f")).collect()}
    assert (rows["a"]["m"], rows["a"]["f"]) == (3, 5)
    assert {r["k"]: r["v_std"] for r in A.mean_std(df, ["k"], ["v"]).collect()}.keys() == {"a", "b"}
    assert {r["k"]: r["v_std"] for r in A.mean_std(df, ["k"], ["v"]).collect()}["b"] == 0


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, None), (2.0, 4.0, 1.0, 1.0), (3.0, 5.0, 1.0, None), (None, 9.0, 1.0, 2.0)], "t double, a double, flat double, gap double")
    r = {x["feature"]: x["r"] for x in A.correlations(df, "t", ["a", "flat", "gap"]).collect()}
    assert abs(r["a"] - 0.9819805060619659) < 1e-12 and r["flat"] is None and r["gap"] is None


@pytest.mark.parametrize("labels,scores,want", [([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75), ([1, 1], [0.1, 0.2], None), ([0, 1], [1.0, 2.0], 1.0), ([1, 0], [1.0, 2.0], 0.0), ([0, 1, 0, 1], [1.0, 1.0, 1.0, 1.0], 0.5)])
def test_auc(spark, labels, scores, want):
    df = spark.createDataFrame(list(zip(labels, scores, strict=True)), "y int, s double")
    assert A.auc(df, "y", "s").first()["auc"] == want


def test_auc_by_group(spark):
    rows = [("a", 0, 0.1), ("a", 1, 0.9), ("b", 1, 0.1), ("b", 0, 0.9)]
    assert {r["k"]: r["auc"] for r in A.auc(spark.createDataFrame(rows, "k string, y int, s double"), "y", "s", ["k"]).collect()} == {"a": 1.0, "b": 0.0}


def test_t_statistics(spark):
    from quartzloom.functions.stats import one_tailed_test, t_survival

    df = spark.createDataFrame([("up", 0.6), ("up", 0.6), ("eq", 0.5), ("eq", 0.5), ("lo", 0.1), ("lo", 0.1), ("x", 0.6), ("x", 0.7), ("x", 0.8)], "k string, v double")
    r = {x["k"]: x for x in one_tailed_test(df, ["k"], "v").collect()}
    assert r["up"]["t"] == math.inf and r["up"]["p"] == 0 and r["up"]["significant"]
    assert r["eq"]["t"] == 0 and not r["eq"]["significant"] and r["lo"]["t"] == 0
    assert abs(r["x"]["t"] - 3.4641016) < 1e-6 and abs(r["x"]["p"] - 0.0370899) < 1e-5
    assert abs(t_survival(1.812461, 10) - 0.05) < 1e-6 and t_survival(0, 5) == 0.5


def test_moments_of_large_means(spark):
    """Ten batches of mean 1e8 .. 1e8 + 9 and variance 1: differences of squares would cancel."""
    parts = spark.createDataFrame([("a", 1000, 1e8 + i, 1000.0) for i in range(10)] + [(None, 1000, 1e8, 1000.0)] * 10 + [("a", 0, None, None)], "k string, n long, mean double, m2 double")
    r = {x["k"]: x for x in A.merge_moments(parts, ["k"]).collect()}
    assert r["a"]["n"] == 10_000 and abs(r["a"]["var"] - 9.25) < 1e-6 and abs(r["a"]["mean"] - (1e8 + 4.5)) < 1e-6
    assert abs(r[None]["var"] - 1) < 1e-9


@pytest.mark.parametrize("held", [0, 64, 4096])
def test_quantiles(spark, held):
    """At once, and ranked in ranges, with a hot key, ties, missing values and a key of none."""
    r = random.Random(1)
    rows = [(("hot" if i % 3 else f"k{i % 20}"), None if i % 11 == 0 else round(r.lognormvariate(0, 2), 1)) for i in range(3000)] + [("none", None), (None, 4.0), (None, 5.0), ("one", 7.0)]
    out = A.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", held=held, med=0.5, q9=0.9, top=1.0)
    by = defaultdict(list)
    for k, v in rows:
        by[k] += [v] if v is not None else []
    got = {x["k"]: x for x in out.collect()}
    assert set(got) == set(by)
    for k, v in by.items():
        for name, p in (("med", 0.5), ("q9", 0.9), ("top", 1.0)):
            assert got[k][name] == (pytest.approx(np.quantile(v, p), rel=1e-12) if v else None)


def test_quantiles_of_large_keys(spark):
    """A hot key of many values in three quantiles, NaN last; nothing runs before the action, and the ranked values are few."""
    n = 200_000
    rows = spark.range(n, numPartitions=6).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("v"))
    rows = rows.unionByName(spark.range(50).select(F.lit("hot").alias("k"), F.lit(float("nan")).alias("v")))
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("quantiles", "")
    out = A.quantiles(rows, ["k"], "v", held=20_000, low=0.001, med=0.5, top=1.0)
    assert not tracker.getJobIdsForGroup("quantiles")
    got = {x["k"]: x for x in out.collect()}
    sc.setLocalProperty("spark.jobGroup.id", None)
    frame = rows.toPandas()
    for key, v in frame.groupby("k")["v"]:
        v = np.sort(v.to_numpy())
        assert got[key]["low"] == pytest.approx(np.interp(0.001 * (len(v) - 1), range(len(v)), v), rel=1e-12)
        assert got[key]["med"] == pytest.approx(np.interp(0.5 * (len(v) - 1), range(len(v)), v), rel=1e-12)
        assert math.isnan(got[key]["top"]) if key == "hot" else got[key]["top"] == v[-1]
    assert len(got) == frame["k"].nunique()


def test_moments_merge(spark):
    parts = spark.createDataFrame([("a", 2, 1.0, 2.0), ("a", 3, 4.0, 6.0)], "k string, n long, mean double, m2 double")
    r = A.merge_moments(parts, ["k"]).first()
    xs = [0, 2, 4 - math.sqrt(3), 4, 4 + math.sqrt(3)]
    m = sum(xs) / 5
    assert abs(r["mean"] - m) < 1e-12 and abs(r["var"] - sum((x - m) ** 2 for x in xs) / 5) < 1e-12


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (1, 11), (None, 12)], "k int, w int")
    assert Counter(a.join(b, "k").select("v", "w").collect()) == Counter([("x", 10), ("x", 11)])
    with pytest.raises(KeyError):
        joins.checked_lookup(a.dropna(), b, "k")
    assert filters.not_in_keys(a, b, "k").count() == 2
    yes, no = filters.split_by(a, F.col("k") == 1)
    assert (yes.count(), no.count()) == (1, 2)


@pytest.mark.parametrize("strand,want", [(1, [100, 104, 200, 201]), (-1, [202, 200, 104, 103])])
def test_exons(spark, strand, want):
    exons = spark.createDataFrame([("g", 100, 104, strand), ("g", 200, 202, strand)], "k string, start long, end long, strand int")
    at = [0, 4, 5, 6] if strand == 1 else [0, 2, 3, 4]
    offsets = spark.createDataFrame([("g", o) for o in [*at, 8]], "k string, offset long")
    assert [r["position"] for r in joins.map_offsets(exons, offsets, "k").orderBy("offset").collect()] == want


def test_within_is_complete(spark):
    import random

    r = random.Random(0)
    pts = [(i, *(r.random() * 3 - 1.5 for _ in range(3))) for i in range(80)]
    left = spark.createDataFrame(pts[:40], "l_id int, l_x double, l_y double, l_z double")
    right = spark.createDataFrame(pts[40:], "r_id int, r_x double, r_y double, r_z double")
    want = {(a[0], b[0]) for a in pts[:40] for b in pts[40:] if sum((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True)) <= 0.25}
    got = joins.within(left, right, 0.5).select("l_id", "r_id").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, a string"), spark.createDataFrame([(2, 0.5)], "i int, b double")
    assert sorted(map(tuple, sets.union_mixed(a, b).collect())) == [(1, "x", None), (2, None, 0.5)]
    assert sets.missing_columns(a, ["i", "z"]) == {"z"}
    assert not sets.are_disjoint(a, a, "i") and sets.are_disjoint(a, b, "i")


def test_observed_removals(spark):
    df = column(spark, ["a", "", None, "b"])
    kept, seen = filters.non_empty(df, "x")
    assert kept.count() == 2
    assert seen.get == {"rows": 4, "removed": 2}


def test_distinct_evaluation(spark, tmp_path):
    log = tmp_path / "calls"

    def provider(xs):
        with open(log, "a") as f:
            f.writelines(f"{x}\n" for x in xs)
        return [x.upper() for x in xs]

    df = column(spark, ["a", "b", "a", None, "a"])
    out = map_distinct(df, "x", injected(provider, "string"), "u").cache()
    assert values(out, "u") == ["A", "B", "A", None, "A"]
    assert sorted(log.read_text().split()) == ["a", "b"]
    with pytest.raises(ValueError):
        injected(None, "string")
