"""Injected functions, with deterministic stand-ins: upper-casing for a canonicaliser, digits for a scaffold, letter counts for bits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzloom.functions import providers as P
from quartzloom.models import svgp
from quartzloom.models.train import predictor
from quartzloom.sources.readers import cached_files


def make():
    """A local function travels to the workers with its code."""

    def upper(x):
        if "!" in x:
            raise ValueError("no structure")
        return x.upper()

    return upper


upper = make()


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(0, "c1cc"), (1, "cc"), (2, "!"), (3, None)], "i int, x string")


def out(df, c):
    return [r["v"] for r in df.select("i", c.alias("v")).orderBy("i").collect()]


def test_structures(df):
    assert out(df, P.canonical(upper)(F.col("x"))) == ["C1CC", "CC", None, None]
    assert out(df, P.scaffold(lambda x, upper=upper: "".join(c for c in upper(x) if c.isdigit()))(F.col("x"))) == ["1", "", None, None]


def test_fingerprints(df):
    got = out(df, P.fingerprint(lambda x, upper=upper: [x.count("c"), int("1" in upper(x))], 2)(F.col("x")))
    assert [(g["fingerprint"], g["error"]) for g in got[:3]] == [([3, 1], None), ([2, 0], None), (None, "no structure")]
    assert got[3]["fingerprint"] is None and got[3]["error"]
    assert out(df, P.fingerprint(lambda x: [1], 2)(F.col("x")))[0]["error"] == "1 bits"


def test_embedder_and_modes(df):
    got = out(df, P.embedder(lambda: lambda xs: [[float(len(x)), float(len(xs))] for x in xs], batch=2)(F.col("x")))
    assert [g and g[0] for g in got] == [4.0, 2.0, 1.0, None] and all(g[1] <= 2 for g in got[:3])
    v = df.select("i", F.array(F.lit(1.0)).alias("ligand_vec"), F.array(F.lit(2.0)).alias("protein_vec"))
    assert [out(v, P.features(m))[0] for m in ("ligand", "protein", "concat")] == [[1.0], [2.0], [1.0, 2.0]]


def test_predictor(spark):
    x = np.random.default_rng(0).normal(size=(60, 2))
    s = svgp.fit(x, (x[:, 0] > 0).astype(float), svgp.Settings(inducing=10, lr=0.05, epochs=20))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>").select("i", predictor(s)(F.col("v")).alias("p")).orderBy("i").collect()
    assert np.allclose([r["p"]["probability"] for r in rows], svgp.predict(s, x)[2])
    assert np.mean([r["p"]["label"] == (v[0] > 0) for r, v in zip(rows, x, strict=True)]) > 0.8


def test_cached_files(spark, tmp_path):
    """Of the name patterns the first that exists counts, not every one."""
    for name in ("1abc.pdb", "pdb1abc.ent", "pdb2xyz.ent", "other.pdb"):
        (tmp_path / name).write_bytes(name.encode())
    rows = cached_files(spark, str(tmp_path), ["1abc", "2xyz", "none"]).collect()
    assert sorted((r["key"], r["name"], bytes(r["content"])) for r in rows) == [("1abc", "1abc.pdb", b"1abc.pdb"), ("2xyz", "pdb2xyz.ent", b"pdb2xyz.ent")]
