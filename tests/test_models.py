"""Solvers: optimality conditions, accuracy, and the linkage."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzloom.functions import vectors as V
from quartzloom.models import cluster, pairs, svgp, svm, train
from quartzloom.models.train import sweep, sweep_logs
from quartzloom.operators.joins import grid


def moons(n=200, seed=0):
    r = np.random.default_rng(seed)
    t = r.uniform(0, np.pi, n)
    y = np.arange(n) % 2
    x = np.where(y[:, None] == 0, np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.5 - np.sin(t)])
    return x + r.normal(0, 0.12, x.shape), np.where(y == 1, 1, -1)


def conditions(m, y, f, c, tol=0.02):
    """0 <= alpha <= C, sum(alpha y) = 0, and the margins."""
    assert (m.alpha >= -1e-9).all() and (m.alpha <= c + 1e-9).all()
    assert abs((m.alpha * y).sum()) < 1e-6
    margin = y * f
    assert (margin[m.alpha < 1e-5] > 1 - tol).all() and (margin[m.alpha > c - 1e-5] < 1 + tol).all()


def test_kernel_svm():
    x, y = moons()
    k = svm.rbf_matrix(x, x, 2.0)
    m = svm.fit_kernel(k, y, svm.Options(C=5.0))
    f = svm.decide_kernel(m, k, y)
    conditions(m, y, f, 5.0)
    assert (np.sign(f) == y).mean() > 0.95
    xt, yt = moons(seed=1)
    assert (np.sign(svm.decide_kernel(m, svm.rbf_matrix(xt, x, 2.0), y)) == yt).mean() > 0.93


def test_linear_svm():
    r = np.random.default_rng(0)
    x = r.normal(size=(150, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1, -1)
    m = svm.fit_linear(x, y, svm.Options(C=1.0))
    conditions(m, y, svm.decide_linear(m, x), 1.0, 0.05)
    assert (np.sign(svm.decide_linear(m, x)) == y).mean() > 0.95
    assert svm.fit_linear(np.zeros((4, 2)), np.array([1, -1, 1, -1])).status == "degenerate"
    assert svm.fit_linear(x, np.ones(150)).status == "degenerate"


def test_factorised_models_equal_those_of_pairs():
    r = np.random.default_rng(1)
    left, right = r.normal(size=(12, 3)), r.normal(size=(9, 2))
    pairs = np.array([(i, j) for i in range(12) for j in range(9)])
    x = np.c_[left[pairs[:, 0]], right[pairs[:, 1]]]
    y = np.where(x @ np.array([1, -1, 0.5, 1, 0.2]) > 0, 1, -1)
    a, b = svm.fit_pairs_linear(left, right, pairs, y), svm.fit_linear(x, y)
    assert np.abs(a.w - b.w).max() < 0.05 * np.abs(b.w).max()  # the optimum is unique, the way to it is not
    assert (np.sign(svm.decide_linear(a, x)) == np.sign(svm.decide_linear(b, x))).mean() > 0.98
    gl, gr = svm.rbf_matrix(left, left, 0.3), svm.rbf_matrix(right, right, 0.3)
    m = svm.fit_pairs_kernel(gl, gr, pairs, y, svm.Options(candidates=128, max_iter=200))
    k = gl[np.ix_(pairs[:, 0], pairs[:, 0])] * gr[np.ix_(pairs[:, 1], pairs[:, 1])]
    whole = svm.fit_kernel(k, y)  # from the Gram matrix of all pairs
    f, g = svm.decide_kernel(m, k, y), svm.decide_kernel(whole, k, y)
    conditions(whole, y, g, 1.0, 0.05)
    assert np.abs(f - g).max() < 0.1 and (np.sign(f) == y).mean() > 0.9


@pytest.mark.parametrize("optimizer", ["adam", "sgld"])
def test_gaussian_process(optimizer):
    x, y = moons(300)
    losses = []
    lr = 0.05 if optimizer == "adam" else 2e-4
    s = svgp.fit(x, (y > 0).astype(float), svgp.Settings(inducing=25, lr=lr, epochs=60, batch=100, optimizer=optimizer), lambda e, s, m: losses.append(m["loss"]))
    p = svgp.predict(s, x)[2]
    assert ((p > 0.5) == (y > 0)).mean() > 0.8 and svm.auc(y, p) > 0.85
    assert losses[-1] < losses[0] and svgp.divergence(s) >= 0


def own_kernel(a, b, log_scale, log_power):
    """A rational-quadratic kernel, as one would write it."""
    d = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
    return (1 + d * np.exp(log_scale[0])) ** -np.exp(log_power[0])


KERNELS = {
    "ard": svgp.SquaredExponential(), "shared": svgp.SquaredExponential(ard=False),
    "own": svgp.KernelFunction(own_kernel, lambda d: {"log_scale": np.zeros(1), "log_power": np.zeros(1)}),
}


@pytest.mark.parametrize("kind", sorted(KERNELS))
def test_gradients_agree_with_differences(kind):
    """Every gradient, through kernel and encoder, also that of the encoder by way of the inducing points."""
    r = np.random.default_rng(0)
    x, y, noise = r.normal(size=(12, 4)), r.integers(0, 2, 12).astype(float), r.standard_normal((20, 12))
    low = np.tril(r.normal(size=(5, 5))) * 0.2 + np.eye(5)
    kernel = KERNELS[kind]
    s = svgp.State(x[:5] + 0.1, r.normal(size=5), low, {k: v + r.normal(size=v.shape) * 0.3 for k, v in kernel.init(2).items()}, 0.1, {"w": r.normal(size=(4, 2)) * 0.5}, svgp.Settings(kernel=kernel, encoder_dim=2))
    g, metrics = svgp.gradients(s, x, y, 30, noise)
    whole = svgp.loss(s, x, y, 30, noise)
    assert metrics["loss"] == pytest.approx(whole, rel=1e-9) and metrics["kl_divergence"] == pytest.approx(svgp.divergence(s), rel=1e-9)

    def moved(name, at, by):
        part, _, leaf = name.partition(".")
        held = {"kernel": "params", "encoder": "encoding"}.get(part, name)
        value = getattr(s, held)[leaf] if leaf else np.array(getattr(s, held), float)
        value = value.copy()
        value[at] += by
        return svgp.loss(replace(s, **{held: getattr(s, held) | {leaf: value} if leaf else value}), x, y, 30, noise)

    for name, slopes in g.items():
        for at in list(np.ndindex(np.shape(slopes)))[:12]:
            if name == "low" and at[1] > at[0]:
                continue
            slope = (moved(name, at, 1e-6) - moved(name, at, -1e-6)) / 2e-6
            assert abs(slope - slopes[at]) < 2e-3 * max(1, abs(slope)), (name, at)


def test_inducing_points_follow_the_encoder():
    x, y = moons(120)
    x = np.c_[x, x * 0.5]
    s = svgp.fit(x, (y > 0).astype(float), svgp.Settings(inducing=10, epochs=20, lr=0.05, encoder_dim=2))
    assert all((s.raw[i] == x).all(1).any() for i in range(10))  # still inputs
    assert np.allclose(s.z, s.raw @ s.encoding["w"])
    start = svgp.fit(x, (y > 0).astype(float), svgp.Settings(inducing=10, epochs=0, encoder_dim=2))
    assert not np.allclose(start.z, s.z)
    free = svgp.fit(x, (y > 0).astype(float), svgp.Settings(inducing=10, epochs=3, lr=0.05, learn_inducing=True, learn_offset=False, learn_kernel=False))
    assert free.offset == 0 and not np.allclose(free.raw, svgp.fit(x, (y > 0).astype(float), svgp.Settings(inducing=10, epochs=0)).raw)
    assert (free.params["log_gamma"] == free.kernel.init(4)["log_gamma"]).all()


def test_own_kernel_and_encoder_fit():
    class Squares(svgp.LinearEncoder):
        def value(self, p, x):
            return super().value(p, np.c_[x, x * x])

        def init(self, rng, d):
            return super().init(rng, 2 * d)

        def pull(self, p, x, g):
            own, back = super().pull(p, np.c_[x, x * x], g)
            return own, back[:, : x.shape[1]] + 2 * x * back[:, x.shape[1] :]

    x, y = moons(200)
    s = svgp.fit(x, (y > 0).astype(float), svgp.Settings(inducing=15, lr=0.05, epochs=40, kernel=KERNELS["own"], encoder=Squares(3)))
    assert svm.auc(y, svgp.predict(s, x)[2]) > 0.9
    assert np.isnan(svgp.participation_ratio(s))
    shared = svgp.fit(x, (y > 0).astype(float), svgp.Settings(inducing=15, epochs=2, ard=False))
    assert shared.params["log_gamma"].shape == (1,)


def test_a_bias_moves_the_collective_variable():
    x, y = moons(150)
    x = np.c_[x, np.random.default_rng(0).normal(size=(150, 4))]
    seen = []
    plain = svgp.Settings(inducing=10, lr=0.05, epochs=30, batch=50)
    fit = lambda **more: svgp.fit(x, (y > 0).astype(float), replace(plain, **more), lambda e, s, m: seen.append(m))
    fit(collective=svgp.participation, bias=svgp.harmonic(1.0, 500.0))
    low = seen[-1]
    assert [set(m) for m in seen[:1]] == [{"loss", "physical_potential", "kl_divergence", "participation_ratio", "cv_val", "bias_energy"}]
    assert low["loss"] == pytest.approx(low["physical_potential"] + low["bias_energy"]) and low["cv_val"] == pytest.approx(low["participation_ratio"])
    seen.clear()
    fit(collective=svgp.participation, bias=svgp.harmonic(6.0, 500.0))
    assert seen[-1]["cv_val"] > low["cv_val"] + 1
    seen.clear()
    s = fit(collective=svgp.participation, bias=svgp.hills(0.5, 0.2, every=10))
    assert s.bias_state[0] == 90 and len(s.bias_state[1]) == 9 and seen[-1]["bias_energy"] > 0


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    while len(groups) > k:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


def test_ward():
    x = np.random.default_rng(2).normal(size=(30, 3))
    paths = cluster.cuts(cluster.ward(x), 30, 8)
    for k in range(2, 9):
        got = {frozenset(np.flatnonzero(paths[:, k - 2] == v)) for v in set(paths[:, k - 2])}
        assert got == brute_ward(x, k)


def test_ward_of_many_points_and_of_equal_ones():
    import tracemalloc

    x = np.repeat(np.random.default_rng(4).normal(size=(10, 3)), 3, 0)
    merges = cluster.ward(x)
    assert [round(h, 9) for _, _, h in merges[:20]] == [0] * 20
    paths = cluster.cuts(merges, 30, 10)
    assert {frozenset(np.flatnonzero(paths[:, 8] == v)) for v in set(paths[:, 8])} == {frozenset(range(i, i + 3)) for i in range(0, 30, 3)}
    tracemalloc.start()
    assert len(cluster.ward(np.random.default_rng(5).normal(size=(1500, 8)))) == 1499
    assert tracemalloc.get_traced_memory()[1] < 8 * 1500 * 1500  # less than one matrix of distances
    tracemalloc.stop()


def test_ward_paths_are_of_all_vectors(spark):
    from quartzloom.plans.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    rows = QUERIES["ward_paths"](spark, d)
    assert rows.count() == rows.select("vec_id").distinct().count() == spark.read.parquet(f"{d}/embeddings.parquet").count() and {len(r["path"]) for r in rows.collect()} == {9}


def test_ward_in_rounds_over_blocks_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 60)
    x = np.random.default_rng(6).normal(size=(150, 4))
    x[140:] = x[:10]  # copies
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(3)
    z = (x - x.mean(0)) / x.std(0)
    got = {r["id"]: r["path"] for r in cluster.hierarchy_paths(df, "id", "v", 9, last=40).collect()}
    assert [got[i] for i in range(150)] == cluster.cuts(cluster.ward(z), 150, 9).tolist()


def test_ward_rounds_do_not_multiply_the_planners_sizes(spark, monkeypatch):
    sizes, real = [], cluster.packed
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    monkeypatch.setattr(cluster, "packed", lambda df, *a: sizes.append(int(size(df))) or real(df, *a))
    x = np.array([[2.0**i] for i in range(10)])  # the nearest two merge in each round, no others
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = [r["path"] for r in cluster.hierarchy_paths(df, "id", "v", 9, last=3).orderBy("id").collect()]
    assert got == cluster.cuts(cluster.ward((x - x.mean(0)) / x.std(0)), 10, 9).tolist()
    assert len(sizes) > 6 and max(sizes) < 1 << 40


def test_ward_of_equal_distances_and_copies(spark):
    cells = [(i, [float(i % 7), float(i // 7 % 7)]) for i in range(98)]  # each point of a lattice twice
    paths = [r["path"] for r in cluster.hierarchy_paths(spark.createDataFrame(cells, "id long, v array<double>"), "id", "v", 98, last=20).orderBy("id").collect()]
    assert [len({p[k] for p in paths}) for k in range(97)] == list(range(2, 99))
    assert all(paths[i][47] == paths[i + 49][47] for i in range(49))  # k = 49: copies together
    one = spark.range(8).selectExpr("id", "array(1D, 2D) as v")
    assert [r["path"] for r in cluster.hierarchy_paths(one, "id", "v", 8).orderBy("id").collect()][0] == [1] * 7
    assert [r["path"] for r in cluster.hierarchy_paths(one.limit(1), "id", "v", 8).collect()] == [[]]
    with pytest.raises(ValueError):
        cluster.hierarchy_paths(spark.sql("select 1L as id, array(1D, double('nan')) as v union all select 2L, array(1D, 2D)"), "id", "v", 2)


def test_clusters(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.1, (20, 4)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    reps = cluster.representatives_of(df, "id", "v", 3, starts=3).collect()
    assert {r["id"] // 20 for r in reps} == {0, 1, 2}
    many, one = cluster.kmeans(df, "v", 3, 3).summary.trainingCost, cluster.kmeans(df, "v", 3, 1).summary.trainingCost
    assert many <= one + 1e-9
    assert cluster.assign(df, "v", cluster.kmeans(df, "v", 3, 1, random_init=True)).select("cluster").distinct().count() <= 3
    paths = cluster.hierarchy_paths(df, "id", "v", 3).orderBy("id").collect()
    assert [r["path"][1] for r in paths] == [1] * 20 + [2] * 20 + [3] * 20
    z = cluster.standard_scale(df.withColumn("v", F.concat("v", F.array(F.lit(7.0)))), "v", "z").select("z").collect()
    assert abs(sum(r["z"][0] for r in z)) < 1e-9 and all(r["z"][4] == 0 for r in z)


def test_sweep(spark):
    x, y = moons(150)
    df = spark.createDataFrame([([float(v) for v in a], int(b > 0)) for a, b in zip(x, y, strict=True)], "v array<double>, y int")
    g = grid(spark, seed=[0, 1], C=[1.0, -1.0])
    rows = {(r["seed"], r["C"]): r for r in sweep(df, "v", "y", "kernel", g).collect()}
    assert len(rows) == 4 and rows[0, 1.0]["test_accuracy"] > 0.8 and rows[0, 1.0]["status"] == "fitted"
    assert {r["status"] for r in sweep(df.withColumn("y", F.lit(1)), "v", "y", "linear", g).collect()} == {"degenerate"}
    logs = sweep_logs(df, "v", "y", grid(spark, seed=[0], lr=[0.05], encoder_dim=[2]), epochs=6, every=2).collect()
    assert sorted(r["epoch"] for r in logs) == [0, 2, 4] and logs[0]["run"] == "model-lr0.05-edim2-seed0"


def test_sweep_fits_and_scores_all_rows(spark, monkeypatch):
    x, y = moons(1300)
    df = spark.createDataFrame([([float(v) for v in a], int(b > 0)) for a, b in zip(x, y, strict=True)], "v array<double>, y int")
    n_test = train.marked_rows(df, "v", "y", 42).filter("test").count()
    g = grid(spark, seed=[0], C=[1.0])
    r = sweep(df, "v", "y", "linear", g).first()
    assert (r["n_train"], r["n_test"]) == (1300 - n_test, n_test)
    rows = train.marked_rows(df, "v", "y", 42).toPandas()
    whole = [(p["x"].tolist(), p["y"].to_numpy()) for p in (rows[~rows.test], rows[rows.test])]
    mine = train.fit("linear", {"seed": 0, "C": 1.0}, *train.arrays(rows[~rows.test]))[1]
    for (a, b), part in zip(whole, ("train", "test"), strict=True):
        score = train.decide(mine, np.array(a))
        assert r[f"{part}_accuracy"] == pytest.approx(((score >= 0) == (b > 0)).mean()) and r[f"{part}_auc"] == pytest.approx(svm.auc(b, score))
    assert train.CAP >= 1300 and sweep(df, "v", "y", "linear", g, cap=None).first() == r
    capped = sweep(df, "v", "y", "linear", g, cap=100).first()
    assert (capped["n_train"], capped["n_test"]) == (100, n_test)
    log = sweep_logs(df, "v", "y", grid(spark, seed=[0], lr=[0.05], encoder_dim=[2]), epochs=1, every=1).first()
    assert log["validation_accuracy"] * n_test == pytest.approx(round(log["validation_accuracy"] * n_test), abs=1e-6) and log["validation_auc"] > 0
    x, y = moons(120)
    held = svm.fit_rbf(x, y, 2.0)
    monkeypatch.setattr(svm, "GRAM", 10)
    assert np.abs(svm.fit_rbf(x, y, 2.0).alpha - held.alpha).max() < 1e-6


def test_representatives_are_of_the_best_of_ten_starts(spark, monkeypatch):
    x, _ = moons(60)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    taken, real = [], cluster.kmeans
    monkeypatch.setattr(cluster, "kmeans", lambda df, vector, k, starts=10: taken.append(starts) or real(df, vector, k, 1))
    assert cluster.representatives_of(df, "id", "v", 2).count() == 2 and taken == [10]


def test_vector_forms(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, float("nan")], [1.0])], "a array<double>, b array<double>, c array<double>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    r = df.select(V.l2(a, 0.0).alias("l2"), V.nan_to_zero(b).alias("nz"), V.delta(a, c).alias("bad"), V.delta(a, a).alias("d"), V.delta(a, c, "wild").alias("w"), V.dot(a, a).alias("dot"), V.rbf(a, a, 1.0).alias("k"), V.participation(F.array(F.lit(1.0), F.lit(1.0))).alias("p"), V.l2_floor(F.array(F.lit(0.0))).alias("zero")).first()
    assert r["l2"] == [0.6, 0.8] and r["nz"] == [1.0, 0.0] and r["bad"] is None and r["d"] == [0.0, 0.0] and r["w"] == [1.0]
    assert r["dot"] == 25 and r["k"] == 1 and r["p"] == 2 and r["zero"] == [0.0]


def test_pair_models_score_every_pair(spark):
    r = np.random.default_rng(6)
    left, right = r.normal(size=(30, 3)), r.normal(size=(4, 2))
    w = r.normal(size=5)
    rows = [(i, j, 1 if np.r_[left[i], right[j]] @ w > 0 else -1) for i in range(30) for j in range(4)]
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    for kind in ("linear", "kernel"):
        for cap in (200, 60):
            out = train.pair_scores(frame(left), frame(right), spark.createDataFrame(rows, "left_id int, right_id int, y int"), kind, cap=cap).collect()
            assert len(out) == 120 and np.mean([(o["score"] > 0) == (o["y"] > 0) for o in out]) > (0.9 if cap == 200 else 0.7)


def exact_pair_scores(block, y, gammas):
    """Scores without b, and the least value, of the model fitted on all pairs."""
    k = pairs.gram(block, block, gammas)
    m = pairs.descend(k, y, np.zeros(len(y)), np.minimum(0, y), np.maximum(0, y), 1e-6, 100_000)
    conditions(svm.Model("", m * y), y, k @ m + np.median((y - k @ m)[(np.abs(m) > 1e-6) & (np.abs(m) < 1 - 1e-6)]), 1.0)
    return k @ m


def test_pair_models_are_fitted_on_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LEAST", 150)  # four parts
    r = np.random.default_rng(6)
    left, right = r.normal(size=(120, 3)), r.normal(size=(6, 2))
    w = r.normal(size=5)
    rows = [(i, j, 1 if np.r_[left[i], right[j]] @ w + r.normal() > 0 else -1) for i in range(120) for j in range(6)]
    li, ri, y = (np.array(c) for c in zip(*rows, strict=True))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    for kind, gammas in (("kernel", [1 / (3 * left.var()), 1 / (2 * right.var())]), ("linear", None)):
        want = exact_pair_scores(pairs.Block(left, right, li, ri), y.astype(float), gammas)
        out = train.pair_scores(frame(left), frame(right), spark.createDataFrame(rows, "left_id int, right_id int, y int"), kind).collect()
        got = {(o["left_id"], o["right_id"], o["y"]): o["score"] for o in out}
        off = np.array([got[row] for row in rows]) - want
        assert len(out) == 720 and off.std() < 0.08 and abs(np.median(off) - off).max() < 0.3
    few = spark.createDataFrame([(0, 0, 1), (1, 1, -1), (2, 2, 1), (120, 0, 1), (121, 0, 1)], "left_id int, right_id int, y int")
    lefts = frame(left).union(spark.sql("select 120, cast(null as array<double>) union all select 121, array(1D, double('nan'), 0D)"))
    got = {o["left_id"]: o["score"] for o in train.pair_scores(lefts, frame(right), few, "kernel").collect()}
    assert got[0] > got[1] < got[2] and got[120] is None and np.isnan(got[121])
    assert {o["score"] for o in train.pair_scores(frame(left), frame(right), few.filter("y = 1 and left_id < 120"), "linear").collect()} == {0.0}
    assert train.pair_scores(frame(left), frame(right), few.limit(0), "kernel").collect() == []


def test_pair_queries_fit_all_vectors(spark):
    from quartzloom.plans.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{d}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, label = np.array(e["embedding"].tolist(), float), e["label"].to_numpy()
    mean = np.array([x[label == k].mean(0) for k in range(10)])
    block = pairs.Block(x, mean, np.r_[: len(x), : len(x)], np.r_[label, (label + 1) % 10])
    want = exact_pair_scores(block, np.r_[np.ones(len(x)), -np.ones(len(x))], [1 / (64 * x.var()), 1 / (64 * mean.var())])
    got = {(r["left_id"], r["y"]): r["score"] for r in QUERIES["svm_pairs_kernel"](spark, d).collect()}
    off = np.array([got[i, s] for s in (1, -1) for i in e["vec_id"]]) - want
    assert len(got) == len(want) and abs(off - np.median(off)).max() < 0.02


def test_effects_of_moves_by_columns_and_by_pairs(monkeypatch):
    r = np.random.default_rng(7)
    a, b = (pairs.Block(r.normal(size=(n, 3)), r.normal(size=(m, 2)), np.r_[:n, r.integers(0, n, n)], np.r_[:m, r.integers(0, m, 2 * n - m)]) for n, m in ((20, 4), (15, 6)))
    (ma, ta), (mb, tb) = (pairs.moves(x.ri % 3, r.normal(size=len(x.ri))) for x in (a, b))
    monkeypatch.setattr(pairs, "CELLS", 100)
    for gammas in ([0.3, 0.6], None):
        k = pairs.gram(a, b, gammas)
        for columns in (128, 2):
            monkeypatch.setattr(pairs, "COLUMNS", columns)
            got = pairs.effects(a, ma, b, mb, gammas)
            assert np.allclose(got[0], k @ mb.table()) and np.allclose(got[1], k.T @ ma.table())
    y, k = np.sign(r.normal(size=40)), pairs.gram(a, a, [0.3, 0.6])
    monkeypatch.setattr(pairs, "CHUNK", 16)  # a chunk knows the moves of those before
    moved = pairs.local(a, y, np.zeros(40), np.zeros(40), 1.0, [0.3, 0.6], 1e-4)
    assert y @ moved - moved @ k @ moved / 2 > 0 and abs(moved.sum()) < 1e-9
    last = slice(32, 40)
    rest = y[last] - (k[last] @ moved - k[last, last] @ moved[last])
    assert np.allclose(moved[last], pairs.descend(k[last, last], rest, np.zeros(8), np.minimum(0, y[last]), np.maximum(0, y[last]), 1e-4, 40))


def test_chunks_drawn_anew_reach_the_best_model(monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 16)
    r = np.random.default_rng(8)
    b = pairs.Block(r.normal(size=(30, 3)), r.normal(size=(2, 2)), np.arange(60) // 2, np.arange(60) % 2)
    y, k = np.where(np.arange(60) < r.integers(20, 40), 1.0, -1.0), pairs.gram(b, b, [0.3, 0.6])
    best = pairs.descend(k, y, np.zeros(60), np.minimum(0, y), np.maximum(0, y), 1e-6, 10_000)
    m = np.zeros(60)
    for turn in range(150):
        m += pairs.local(b, y, m, k @ m, 1.0, [0.3, 0.6], 1e-6, np.random.default_rng(turn))
    value = lambda v: y @ v - v @ k @ v / 2
    assert value(m) > 0.999 * value(best) > 0  # chunks of one class can't move at all where they stay the same


def test_pairs_are_scored_in_blocks_as_by_columns(spark, monkeypatch):
    r = np.random.default_rng(9)
    point = lambda n: [float(v) for v in r.normal(size=n)]
    rows = [((point(3), point(2)), float(a), int(y)) for a, y in zip(r.random(40) - 0.2, r.choice([-1, 1], 40), strict=True)]
    pairs = [(i, point(3), point(2)) for i in range(50)] + [(50, None, point(2)), (51, [float("nan")] * 3, point(2))]
    df = spark.createDataFrame(pairs, "id int, l array<double>, r array<double>")
    support = spark.createDataFrame(rows, "vec struct<l:array<double>,r:array<double>>, alpha double, y int")
    old = V.kernel_scores(df.withColumn("p", F.struct("l", "r")), support, "p", lambda a, b: V.rbf(a["l"], b["l"], 0.3) * V.rbf(a["r"], b["r"], 0.7), 0.5)
    want = {x["id"]: x["score"] for x in old.collect()}
    monkeypatch.setattr(train, "BLOCK", 100)
    scored = df.select("id", train.product_scorer(rows, [0.3, 0.7], 0.5)(F.col("l"), F.col("r")).alias("score"))
    assert {x["id"]: x["score"] for x in scored.collect()} == pytest.approx(want, abs=1e-9, nan_ok=True)
    assert want[50] is None and {x["score"] for x in df.select(train.product_scorer([], [0.3, 0.7], 0.5)(F.col("l"), F.col("r")).alias("score")).collect()} >= {None, 0.5}


def test_padding(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 1)] * 3, "v array<double>, y int")
    assert df.select(V.pad_multiple(F.col("v"), 4).alias("p")).first()["p"] == [1.0, 2.0, 3.0, 0.0]
    assert df.select(V.pad_multiple(F.col("v"), 3).alias("p")).first()["p"] == [1.0, 2.0, 3.0]
    out = V.pad_rows(df, "v", 5).collect()
    assert len(out) == 5 and sum(r["v"] == [0.0] * 3 and r["y"] is None for r in out) == 2 and V.pad_rows(df, "v", 3).count() == 3
