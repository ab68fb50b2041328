"""Curve detection against an index loop; invariants of splits and samples."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quartzloom.operators import curves, splits


def loop(tr, va, w=5, mult=3, delay=5, over=0.9, plateau=0.75, jump=0.05):
    n = len(tr)
    mem = event = -1
    if n >= w * (mult + 1):
        first = next((i for i in range(w - 1, n) if sum(tr[i - w + 1 : i + 1]) / w > over), None)
        if first is not None:
            mem = first
            after = (w - 1) // 2
            sm = []
            for i in range(n):
                part = va[max(0, i - (w - 1 - after)) : i + after + 1]
                sm.append(sum(part) / len(part))
            for i in range(first + 1, n - mult * w):
                if sm[i] < plateau and i - first > delay and sm[i + w] - sm[i] > jump and sum(sm[i + w : i + mult * w]) / ((mult - 1) * w) > plateau:
                    event = i
                    break
    return mem, event


def random_curves(seed, n=80):
    r = random.Random(seed)
    rows, want = [], {}
    for run in range(n):
        length, mem, jump = r.randint(10, 80), r.randint(3, 30), r.randint(15, 60)
        tr = [min(1, max(0, (0.95 if i > mem else 0.5) + r.uniform(-0.04, 0.04))) for i in range(length)]
        va = [min(1, max(0, (0.9 if i > jump else 0.55) + r.uniform(-0.1, 0.1))) for i in range(length)]
        rows += [(run, i * 100, t, v) for i, (t, v) in enumerate(zip(tr, va, strict=True))]
        want[run] = tuple(x * 100 if x >= 0 else -1 for x in loop(tr, va))
    return rows, want


def test_detection(spark):
    rows, want = random_curves(0)
    got = {r["run"]: r for r in curves.detect(spark.createDataFrame(rows, "run long, epoch int, train double, val double")).collect()}
    assert {k: (r["mem"], r["event"]) for k, r in got.items()} == want
    assert sum(g >= 0 for _, g in want.values()) > 10
    for k, (m, g) in want.items():
        assert got[k]["delay"] == (g - m if g >= 0 else -1) and got[k]["detected"] == (g >= 0)


@pytest.mark.parametrize("min_delay", [0, 99, 100, 250])
def test_the_least_delay_is_one_row(spark, min_delay):
    """A window and delay of under 100 epochs still mean one row."""
    tr, va = [0.95] * 12, [0.5, 0.5, 0.5, 0.9] + [0.9] * 8
    rows = [(1, i * 100, t, v) for i, (t, v) in enumerate(zip(tr, va, strict=True))] + [(2, i * 100, t, v) for i, (t, v) in enumerate(zip(tr, [0.5, 0.5] + [0.9] * 10, strict=True))]
    got = {r["run"]: r["event"] for r in curves.detect(spark.createDataFrame(rows, "run long, epoch int, train double, val double"), window=100, min_delay=min_delay).collect()}
    want = {run: loop(tr, [v for n, _, _, v in rows if n == run], w=1, delay=max(1, min_delay // 100))[1] for run in (1, 2)}
    assert got == {run: e * 100 if e >= 0 else -1 for run, e in want.items()} and got[2] == -1


def test_streaming_fills_missing_metrics(spark, tmp_path):
    from quartzloom.streaming.incremental import curve_events

    rows, _ = random_curves(5, 20)
    holes = [(n, e, None if e % 700 == 300 else t, None if e % 500 == 200 or e == 0 else v) for n, e, t, v in rows]
    schema = "run long, epoch int, train double, val double"
    batch = curves.detect(curves.forward_fill(spark.createDataFrame(holes, schema), ["train", "val"])).filter("event >= 0")
    for k in range(3):  # the second file repeats rows of the first, which are late and left out
        spark.createDataFrame([r for r in holes if (25 * k - (10 if k == 1 else 0)) * 100 <= r[1] < 25 * (k + 1) * 100 or (k == 2 and r[1] >= 7500)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = curve_events(stream).writeStream.format("memory").queryName("ql_filled").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["run"], r["mem"], r["event"]) for r in spark.table("ql_filled").collect()} == {(r["run"], r["mem"], r["event"]) for r in batch.collect()}


def test_streaming_detection_agrees(spark, tmp_path):
    from quartzloom.streaming.incremental import curve_events

    rows, want = random_curves(1, 30)
    schema = "run long, epoch int, train double, val double"
    for k in range(3):
        part = [r for r in rows if r[1] // 100 % 90 // 30 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = curve_events(stream).writeStream.format("memory").queryName("ql_events").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["run"]: (r["mem"], r["event"]) for r in spark.table("ql_events").collect()}
    assert got == {k: v for k, v in want.items() if v[1] >= 0}


def test_streaming_moments_and_log(spark, tmp_path):
    from quartzloom.streaming.incremental import append_log, running_moments, windowed_counts

    src = str(tmp_path / "in")
    spark.range(100).selectExpr("id % 3 as k", "cast(id as double) as v", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts").write.parquet(src)
    stream = spark.readStream.schema("k long, v double, ts timestamp_ntz").parquet(src)
    q = running_moments(stream, ["k"], "v").writeStream.format("memory").outputMode("complete").queryName("ql_moments").start()
    q.processAllAvailable()
    q.stop()
    want = {r["k"]: r for r in spark.read.parquet(src).groupBy("k").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")).collect()}
    assert {r["k"]: r for r in spark.table("ql_moments").collect()} == want
    q = append_log(stream, str(tmp_path / "log"), str(tmp_path / "lc"), "0 seconds").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 100
    q = windowed_counts(stream, "ts", "10 seconds", "30 seconds", "k").writeStream.format("memory").outputMode("append").queryName("ql_windows").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.table("ql_windows").collect()) == 60


def test_fill_and_smoothing(spark):
    rows = [(0, 0, None), (0, 1, 1.0), (0, 2, None), (0, 3, 3.0), (0, 4, 5.0)]
    df = curves.forward_fill(spark.createDataFrame(rows, "run int, epoch int, v double"), ["v"])
    out = df.select("epoch", curves.trailing_mean("v", 2).alias("t"), curves.centred_mean("v", 4).alias("e"), curves.centred_mean("v", 3).alias("o")).orderBy("epoch").collect()
    assert [r["t"] for r in out] == [None, 1.0, 2.0, 4.0]
    assert [r["e"] for r in out] == [1.0, 5 / 3, 2.5, 3.0]
    assert [r["o"] for r in out] == [1.0, 5 / 3, 3.0, 4.0]


def greedy(rows, share=0.2):
    """The scaffold split of one target, one scaffold after the other."""
    if len(rows) < 3:
        return {i: "train" for i, _ in rows}
    groups = defaultdict(list)
    for i, s in rows:
        if s:
            groups[s].append(i)
    target = int(len(rows) * share) or 1
    test, train = [], []
    for _, ids in sorted(groups.items(), key=lambda x: len(x[1])):
        (test if len(test) < target else train).extend(ids)
    if not test or not train:
        return {i: "train" for i, _ in rows}
    return {i: "test" if i in set(test) else "train" if i in set(train) else "dropped" for i, _ in rows}


def test_scaffold_split(spark):
    r = random.Random(3)
    rows = []
    for t in range(40):
        for _ in range(r.randint(1, 25)):
            rows.append((t, len(rows), r.choice(["", "", "a", "b", "c", "d", "e"][: r.randint(1, 7)])))
    got = {r["i"]: r["side"] for r in splits.scaffold_split(spark.createDataFrame(rows, "t int, i int, s string"), "t", "s", ["i"]).collect()}
    by = defaultdict(list)
    for t, i, s in rows:
        by[t].append((i, s))
    assert got == {k: v for g in by.values() for k, v in greedy(g).items()}


@pytest.fixture(scope="module")
def pool(spark):
    r = random.Random(4)
    rows = [(f"t{t}", i, r.random() < 0.4, f"s{r.randint(0, 6)}", None if r.random() < 0.1 else t % 4, t % 7, 1) for t in range(20) for i in range(r.randint(1, 40))]
    return spark.createDataFrame(rows, "target string, id int, active boolean, scaffold string, k2_cluster int, k3_cluster int, k4_cluster int").cache()


def test_balanced_sample(pool):
    rows = pool.collect()
    actives, inactives = Counter(r["target"] for r in rows if r["active"]), Counter(r["target"] for r in rows if not r["active"])
    for scaffold in (None, "scaffold"):
        out = splits.balanced_sample(pool, "target", "active", ["id"], 5, scaffold=scaffold).collect()
        assert len(set(out)) == len(out) and set(out) <= set(rows)
        a, i = Counter(r["target"] for r in out if r["active"]), Counter(r["target"] for r in out if not r["active"])
        assert a == Counter({t: min(n, 5) for t, n in actives.items()})
        assert i == Counter({t: min(inactives[t], min(actives[t], 5)) for t in inactives if min(inactives[t], actives[t])})
        if scaffold:
            kinds = {t: {r["scaffold"] for r in rows if r["active"] and r["target"] == t} for t in actives}
            assert all(len({r["scaffold"] for r in out if r["active"] and r["target"] == t}) == min(5, len(kinds[t]), a[t]) for t in a)
    out = splits.balanced_sample(pool, "target", "active", ["id"], 0.5).collect()
    assert Counter(r["target"] for r in out if r["active"]) == Counter({t: n // 2 for t, n in actives.items() if n // 2})
    assert splits.balanced_sample(pool, "target", "active", ["id"], None).count() == len(rows)


def test_culling(pool):
    seen = set()
    before = pool
    levels = list(splits.culling_split(pool, "target", [2, 3, 4], {2, 3, 4}))
    assert [x.name for x in levels] == ["k2", "k3", "k4_from_k3"]
    for x in levels[:2]:
        test, train = ({r["target"] for r in d.select("target").distinct().collect()} for d in (x.test, x.train))
        assert test and not test & train and not test & seen
        assert test | train == {r["target"] for r in before.select("target").distinct().collect()}
        seen |= test
        before = x.train


def test_group_folds(pool):
    labelled = pool.withColumn("y", F.col("active").cast("int"))
    folds = splits.stratified_group_folds(labelled, "target", "y", 4).collect()
    assert len(folds) == pool.select("target").distinct().count() == len({f["target"] for f in folds})
    assert {f["fold"] for f in folds} == {0, 1, 2, 3}
    size = Counter()
    of = {f["target"]: f["fold"] for f in folds}
    for r in labelled.collect():
        size[of[r["target"]]] += r["y"]
    assert max(size.values()) < 2 * min(size.values())
    with pytest.raises(AssertionError):
        splits.assert_disjoint(pool, pool, "target")


def test_numbering(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 as x").repartition(7)
    out = splits.number_rows(df, "x").orderBy("index").collect()
    assert [r["index"] for r in out] == list(range(1000))
    assert [r["x"] for r in out] == sorted(r["x"] for r in out)
    assert Counter(r["chunk"] for r in splits.chunks(df, 300, "x").collect()) == {1: 300, 2: 300, 3: 300, 4: 100}


def test_permutation_is_of_rows(spark, pool):
    """Each group keeps its labels, but they are neither as they were nor moved in blocks."""
    rows = [(t, i, "R" if i < 50 else "N") for t in range(4) for i in range(100)]
    df = spark.createDataFrame(rows, "t int, i int, y string")
    out = splits.permute_labels(df, "t", "y", ["i"]).collect()
    assert sorted((r["t"], r["i"]) for r in out) == [(t, i) for t, i, _ in rows]
    for t in range(4):
        y = [r["y"] for r in sorted(out, key=lambda r: r["i"]) if r["t"] == t]
        assert Counter(y) == {"R": 50, "N": 50}
        assert 15 < sum(x == "R" for x in y[:50]) < 35  # about half of each block has changed
        assert sum(a != b for a, b in zip(y, y[1:], strict=False)) > 30
    assert out != splits.permute_labels(df, "t", "y", ["i"], seed=7).collect()
    mixed = splits.permute_labels(pool.withColumn("target", F.nullif(F.col("target"), F.lit("t3"))).select("target", "scaffold", "id"), "target", "scaffold", ["id"])
    assert mixed.count() == pool.count() and mixed.columns == ["target", "scaffold", "id"]


def test_ranks_by_draw_are_those_of_one_window(pool):
    rows = {(r["target"], r["id"]): r["_r"] for r in splits.ranked(pool, ["target"], splits.draw(42, "id"), "id").collect()}
    assert rows == {(r["target"], r["id"]): r["_r"] for r in splits.ranked_by_draw(pool, ["target"], 42, ["id"]).collect()}


def test_subset(pool):
    assert splits.subset(pool, 7, ["target", "id"]).count() == 7
    assert splits.subset(pool, 10**6, ["target", "id"]).count() == pool.count()


def test_representatives(spark):
    runs = spark.createDataFrame([("a1", "a", 900), ("b1", "b", 100), ("c1", "c", 500), ("c2", "c", 700), ("d1", "d", 600)], "run string, target string, delay int")
    freq = spark.createDataFrame([("c", 0.9), ("a", 0.5)], "target string, freq double")
    got = [tuple(r) for r in curves.representatives(runs, freq).collect()]
    assert got == [("Longest Delay", "a1"), ("Shortest Delay", "b1"), ("Highest Frequency", "c1"), ("Mid Delay (600)", "d1")]


def test_null_targets(spark):
    """A null target is split and sampled like any other; a null label is neither active nor inactive."""
    rows = [(i, None if i % 2 else "t", f"s{i % 10}", [True, False, False, None][i // 2 % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, target string, scaffold string, active boolean")
    sides = splits.scaffold_split(df, "target", "scaffold", ["id"]).collect()
    assert len(sides) == 40 and {(r["target"], r["side"]) for r in sides} == {(t, s) for t in (None, "t") for s in ("train", "test")}
    for cap in (3, 0.5):
        got = splits.balanced_sample(df, "target", "active", ["id"], cap).collect()
        per = {(t, a): sum(r["target"] == t and r["active"] == a for r in got) for t in (None, "t") for a in (True, False)}
        assert per[None, True] == per["t", True] == per[None, False] == per["t", False] == (3 if cap == 3 else 2) and len(got) == 4 * per["t", True]
