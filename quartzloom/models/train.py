"""Many small models at once: a task of a parameter grid is a group, trained by one worker on the rows
that are not for testing, up to CAP of them by draw (a parameter; None for all). Every row is then scored in
partitions with the fitted models, and measures are taken over all scores.

A worker needs memory for a task's training rows, and time that grows faster than their number.
"""

from __future__ import annotations

import pickle
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzloom.functions.vectors import dot, gamma_of
from quartzloom.models import pairs as pairs_model
from quartzloom.models import svgp, svm
from quartzloom.operators.aggregates import auc
from quartzloom.operators.splits import draw
from quartzloom.session import cut

RESULT = "status string, n_train long, n_test long, n_support long, iterations long, train_accuracy double, test_accuracy double, train_auc double, test_auc double"
#: Rows that a model is fitted on at most, unless another number is given.
CAP = 5_000
#: Entries of a kernel matrix held at a time when scoring.
BLOCK = 2_000_000


def marked_rows(df: DataFrame, vector: str, label: str, seed: int) -> DataFrame:
    """(x, y, test, draw) of every row; a fifth is for testing, by a draw that does not depend on partitioning."""
    d = draw(seed, F.col(vector).cast("string"))
    return df.select(F.col(vector).alias("x"), F.col(label).cast("int").alias("y"), d.alias("_d")).select("x", "y", (F.conv(F.substring("_d", 1, 4), 16, 10).cast("int") % 5 == 0).alias("test"), "_d")


def training_rows(rows: DataFrame, cap: int | None) -> DataFrame:
    """(x, y) of the rows not for testing, or of cap of them by draw."""
    train = rows.filter("not test")
    return (train if cap is None else train.orderBy("_d").limit(cap)).select("x", "y")


def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.assign(k=[tuple(x) for x in pdf["x"]]).sort_values(["k", "y"])
    return np.array(pdf["x"].tolist(), float), pdf["y"].to_numpy()


def numbered(grid: DataFrame) -> DataFrame:
    """The tasks of a grid, with a number each."""
    return grid.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(grid.collect())], "_task int, " + ", ".join(f"{n} {t}" for n, t in grid.dtypes))


def fit(kind: str, params: dict, x: np.ndarray, y: np.ndarray) -> tuple[dict, dict]:
    """What is known of the fit, and what scoring needs."""
    sign = np.where(y > 0, 1, -1)
    z, mean, std = svm.scale(x)
    model = {"kind": kind, "mean": mean, "std": std}
    if kind == "svgp":
        settings = svgp.Settings(**{"inducing": 50} | {k: v for k, v in params.items() if k in svgp.Settings.__dataclass_fields__})
        s = svgp.fit(z, y, settings)
        return {"status": "fitted", "n_train": len(x), "n_support": len(s.raw), "iterations": settings.epochs}, model | {"state": s}
    options = svm.Options(**{"max_iter": 100} | {k: v for k, v in params.items() if k in svm.Options.__dataclass_fields__})
    if kind == "linear":
        m = svm.fit_linear(z, sign, options)
        model |= {"w": m.w, "b": m.b}
    else:
        gamma = params.get("gamma") or 1.0 / (z.shape[1] * z.var() or 1.0)
        m = svm.fit_rbf(z, sign, gamma, options)
        model |= {"points": z[m.support], "weights": m.alpha[m.support] * sign[m.support], "b": m.b, "gamma": gamma}
    return {"status": m.status, "n_train": len(x), "n_support": len(m.support), "iterations": m.iterations}, model


def decide(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of rows: at 0 or above, the label is 1."""
    z = svm.normalise(x, model["mean"], model["std"])
    if model["kind"] == "svgp":
        return svgp.predict(model["state"], z)[2] - 0.5
    if model["kind"] == "linear":
        return z @ model["w"] + model["b"]
    step = max(1, BLOCK // max(1, len(model["points"])))
    parts = [svm.rbf_matrix(z[k : k + step], model["points"], model["gamma"]) @ model["weights"] for k in range(0, len(z), step)]
    return np.concatenate(parts) + model["b"]


def scored(rows: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(_task, *keys, test, y, score) of every row by every model (_task, *keys, model). Rows are dealt in parts, and each meets the models of one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = dict(models.dtypes)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("_task", "int32"), *((k, "int32") for k in keys), ("test", bool), ("y", "int32"), ("score", float))})]
        if len(left) and len(right):
            x, y, test = np.array(left["x"].tolist(), float), (left["y"].to_numpy() > 0).astype("int32"), left["test"].to_numpy(bool)
            for _, r in right.iterrows():
                out.append(pd.DataFrame({"_task": r["_task"], **{k: r[k] for k in keys}, "test": test, "y": y, "score": decide(pickle.loads(r["model"]), x)}))
        return pd.concat(out[1:] or out)

    part = F.pmod(F.xxhash64("_d"), F.lit(parts)).cast("int").alias("_part")
    left = rows.select("x", "y", "test", part).join(F.broadcast(models.select(F.col("_task").alias("_of")).distinct()))
    right = models.select("_task", *keys, "model").join(F.broadcast(rows.sparkSession.range(parts).select(F.col("id").cast("int").alias("_part"))))
    schema = ", ".join(["_task int", *(f"{k} {types[k]}" for k in keys), "test boolean", "y int", "score double"])
    return left.groupBy("_of", "_part").cogroup(right.groupBy("_task", "_part")).applyInPandas(run, schema)


def sweep(df: DataFrame, vector: str, label: str, kind: str, grid: DataFrame, cap: int | None = CAP, seed: int = 42) -> DataFrame:
    """The grid's columns with the results of each task. A task that fails has its message as status.

    All rows are scored; cap bounds the rows fitted only (None: all), and train_* are over all rows not for testing.
    """
    names = grid.columns
    facts = ["status", "n_train", "n_support", "iterations"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        params = {n: pdf[n].iloc[0].item() if hasattr(pdf[n].iloc[0], "item") else pdf[n].iloc[0] for n in names}
        try:
            out, model = fit(kind, params, *arrays(pdf))
            out["model"] = pickle.dumps(model)
        except Exception as e:
            out = {"status": f"failed: {e}", "n_train": None, "n_support": None, "iterations": None, "model": None}
        return pd.DataFrame([{"_task": pdf["_task"].iloc[0]} | out])[["_task", *facts, "model"]]

    rows, tasks = marked_rows(df, vector, label, seed), numbered(grid)
    fits = cut(training_rows(rows, cap).join(F.broadcast(tasks)).groupBy("_task").applyInPandas(run, "_task int, status string, n_train long, n_support long, iterations long, model binary"))
    scores = cut(scored(rows, fits.filter("model is not null"), []))
    right = ((F.col("score") >= 0).cast("int") == F.col("y")).cast("int")
    counts = scores.groupBy("_task").agg(F.count_if("test").alias("n_test"), F.avg(F.when(~F.col("test"), right)).alias("train_accuracy"), F.avg(F.when(F.col("test"), right)).alias("test_accuracy"))
    areas = auc(scores, "y", "score", ["_task", "test"]).groupBy("_task").agg(F.max(F.when(~F.col("test"), F.col("auc"))).alias("train_auc"), F.max(F.when(F.col("test"), F.col("auc"))).alias("test_auc"))
    out = tasks.join(fits.select("_task", *facts), "_task").join(counts, "_task", "left").join(areas, "_task", "left")
    return out.select(*names, *(f.split()[0] for f in RESULT.split(", ")))


METRICS = ("loss", "physical_potential", "kl_divergence", "participation_ratio", "cv_val", "bias_energy")
LOG = ", ".join(["run string", "epoch int", *(f"{m} double" for m in METRICS), "validation_accuracy double", "validation_auc double", "train_accuracy double", "train_auc double"])


def sweep_logs(df: DataFrame, vector: str, label: str, grid: DataFrame, epochs: int = 300, every: int = 100, cap: int | None = CAP, seed: int = 42, **settings) -> DataFrame:
    """Training curves of each task (seed, lr, encoder_dim), a row every so many epochs: the input of the curve detector, with the columns of a run log.

    validation_* are over all rows for testing, train_* over a sample of as many of the fitted rows. settings: others of
    svgp.Settings, such as collective and bias.
    """
    names = grid.columns
    rows, tasks = marked_rows(df, vector, label, seed), numbered(grid)
    n_test = rows.filter("test").count()
    kept = ["_task", "run", "epoch", *METRICS, "train_accuracy", "train_auc", "model"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = {n: pdf[n].iloc[0].item() for n in names}
        x, y = arrays(pdf)
        z, mean, std = svm.scale(x)
        logged = []
        name = f"model-lr{p['lr']:g}-edim{p['encoder_dim']}-seed{p['seed']}"
        part = np.random.default_rng(p["seed"]).permutation(len(x))[: max(1, n_test)]

        def log(epoch: int, s: svgp.State, metrics: dict[str, float]) -> None:
            if epoch % every == 0:
                score = svgp.predict(s, z[part])[2]
                bare = replace(s, settings=replace(s.settings, collective=None, bias=None), bias_state=None)
                model = pickle.dumps({"kind": "svgp", "mean": mean, "std": std, "state": bare})
                logged.append((pdf["_task"].iloc[0], name, epoch, *(metrics[m] for m in METRICS), float(((score > 0.5) == (y[part] > 0)).mean()), svm.auc(y[part], score), model))

        svgp.fit(z, y, svgp.Settings(**{"inducing": 30} | settings | {"lr": p["lr"], "encoder_dim": p["encoder_dim"], "seed": p["seed"], "epochs": epochs}), log)
        return pd.DataFrame(logged, columns=kept)

    schema = ", ".join(["_task int, run string, epoch int", *(f"{c} double" for c in kept[3:-1]), "model binary"])
    logs = cut(training_rows(rows, cap).join(F.broadcast(tasks)).groupBy("_task").applyInPandas(run, schema))
    scores = cut(scored(rows.filter("test"), logs, ["epoch"]))
    right = ((F.col("score") > 0).cast("int") == F.col("y")).cast("int")
    counts = scores.groupBy("_task", "epoch").agg(F.avg(right).alias("validation_accuracy"))
    out = logs.drop("model").join(counts, ["_task", "epoch"], "left").join(auc(scores, "y", "score", ["_task", "epoch"]).withColumnRenamed("auc", "validation_auc"), ["_task", "epoch"], "left")
    return out.select(*(F.coalesce(n, F.lit(float("nan"))).alias(n) if n.startswith("validation") else n for n in (f.split()[0] for f in LOG.split(", "))))


def pair_scores(left: DataFrame, right: DataFrame, pairs: DataFrame, kind: str, cap: int | None = None, seed: int = 42, gap: float = 1e-3, **options) -> DataFrame:
    """(left_id, right_id, y, score) of every pair, by a model of concatenated vectors (linear) or of the product of two kernels (kernel).

    left, right (id, vec); pairs (left_id, right_id, y in -1, 1). The model is fitted on all pairs over the cluster, up
    to a duality gap (a share of the primal value). With a ``cap`` one worker fits it on so many pairs at most, chosen by
    draw, and all pairs are scored where they are joined. A pair with a missing vector has no score, one with missing
    places NaN; neither is fitted on. Pairs of one class only score 0.
    """
    both = pairs.join(left.toDF("left_id", "_l"), "left_id").join(right.toDF("right_id", "_r"), "right_id")
    if cap is None:
        both = cut(both)
        lacks = F.lit(False)
        for v in ("_l", "_r"):
            lacks = lacks | F.col(v).isNull() | F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(True))
        whole = both.filter(~lacks)
        if whole.select("y").distinct().count() < 2:
            fitted = whole.select("left_id", "right_id", "y", F.lit(0.0).alias("score"))
        else:
            used = [(whole.select(F.col(i).alias("id")).distinct(), v.toDF("id", "vec")) for i, v in (("left_id", left), ("right_id", right))]
            gammas = [gamma_of(v.join(i, "id", "left_semi"), "vec") for i, v in used] if kind == "kernel" else None
            fitted = pairs_model.fit_scores(whole, gammas, svm.Options(**{"max_iter": 200} | options), gap, seed)
        missing = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit(float("nan")))
        return fitted.unionByName(both.filter(lacks).select("left_id", "right_id", "y", missing.alias("score")))
    sample = both.orderBy(draw(seed, "left_id", "right_id", "y"), "left_id", "right_id", "y").limit(cap)

    def run(pdf: pd.DataFrame) -> tuple:
        pdf = pdf.sort_values(["left_id", "right_id", "y"])
        at = np.array([pd.factorize(pdf[i])[0] for i in ("left_id", "right_id")]).T
        first = [np.unique(at[:, k], return_index=True)[1] for k in (0, 1)]
        tables = [np.array(pdf[v].iloc[f].tolist(), float) for v, f in zip(("_l", "_r"), first, strict=True)]
        y = pdf["y"].to_numpy()
        if kind == "linear":
            m = svm.fit_pairs_linear(*tables, at, y, svm.Options(**options))
            w = m.w if m.w is not None else np.zeros(sum(t.shape[1] for t in tables))
            return w[: tables[0].shape[1]].tolist(), w[tables[0].shape[1] :].tolist(), float(m.b)
        gammas = [float(1.0 / (t.shape[1] * t.var() or 1.0)) for t in tables]
        m = svm.fit_pairs_kernel(*(svm.rbf_matrix(t, t, g) for t, g in zip(tables, gammas, strict=True)), at, y, svm.Options(**{"candidates": 128, "max_iter": 200} | options))
        rows = [((tables[0][at[i, 0]].tolist(), tables[1][at[i, 1]].tolist()), float(m.alpha[i]), int(y[i])) for i in m.support]
        return rows, gammas, float(m.b)

    fitted = in_worker(sample, run)
    if fitted is None:
        return both.select("left_id", "right_id", "y", F.lit(0.0).alias("score"))
    lit = lambda a: F.array(*(F.lit(float(v)) for v in a))
    if kind == "linear":
        left_w, right_w, b = fitted
        return both.select("left_id", "right_id", "y", (dot(F.col("_l"), lit(left_w)) + dot(F.col("_r"), lit(right_w)) + b).alias("score"))
    rows, gammas, b = fitted
    return both.select("left_id", "right_id", "y", product_scorer(rows, gammas, b)(F.col("_l"), F.col("_r")).alias("score"))


def product_scorer(rows: list[tuple], gammas: list[float], b: float, eps: float = 1e-5):
    """A column function of the vectors of a pair: sum of alpha y k(l, left) k(r, right) + b over support pairs ((l, r), alpha, y) with alpha > eps. They are bounded by the model's training set."""
    rows = [r for r in rows if r[1] > eps]
    points = [np.array([r[0][k] for r in rows], float) for k in (0, 1)]
    weights = np.array([r[1] * r[2] for r in rows], float)
    step = max(1, BLOCK // max(1, len(rows)))

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        there = np.flatnonzero(left.notna() & right.notna())
        out = np.full(len(left), np.nan)
        for k in range(0, len(there), step):
            at = there[k : k + step]
            grams = [svm.rbf_matrix(np.array(v.iloc[at].tolist(), float), p, g) for v, p, g in zip((left, right), points, gammas, strict=True)] if rows else []
            out[at] = (grams[0] * grams[1]) @ weights + b if rows else b
        return pd.Series(out)

    # what comes back missing has NaN in its vectors; a missing vector has no score
    return lambda left, right: F.when(left.isNotNull() & right.isNotNull(), F.coalesce(run(left, right), F.lit(float("nan"))))


def in_worker(df: DataFrame, function) -> object:
    """function(all rows as pandas), computed by one task; None without rows. The caller bounds the rows. A driver does no solving: threaded algebra can hang beside a JVM."""
    rows = df.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda pdf: pd.DataFrame({"out": [pickle.dumps(function(pdf))]}), "out binary").collect()
    return pickle.loads(rows[0]["out"]) if rows else None


def predictor(state: svgp.State):
    """A column function of scaled vectors: struct(mean, variance, probability, label). The state is a few inducing points."""
    kind = T.StructType([*(T.StructField(n, T.DoubleType()) for n in ("mean", "variance", "probability")), T.StructField("label", T.IntegerType())])

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.DataFrame:
        mean, var, p = svgp.predict(state, np.array(x.tolist(), float))
        return pd.DataFrame({"mean": mean, "variance": var, "probability": p, "label": (p > 0.5).astype("int32")})

    return run
