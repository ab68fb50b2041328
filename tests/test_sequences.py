"""Sequence functions, against plain Python."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quartzloom.functions import sequences as X


def run(spark, rows, schema, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["v"] for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def test_point_mutations(spark):
    got = run(spark, [("EGFR T790M, L858R T790M",), ("none",), (None,), ("A20B A100B",)], "x string", X.point_mutations(F.col("x")))
    assert got == ["L858R,T790M", None, None, "A100B,A20B"]


def test_diff_and_edits_are_inverse(spark):
    r = random.Random(0)
    rows = []
    for _ in range(60):
        w = "".join(r.choice("ACDEFGHIKL") for _ in range(r.randint(1, 15)))
        m = list(w)
        for _ in range(r.randint(0, 3)):
            m[r.randrange(len(m))] = r.choice("ACDEFGHIKL")
        rows.append((w, "".join(m)))
    diff = run(spark, rows, "w string, m string", X.sequence_diff(F.col("w"), F.col("m")))
    assert all((d is None) == (w == m) for d, (w, m) in zip(diff, rows, strict=True))
    back = run(spark, [(w, d) for (w, _), d in zip(rows, diff, strict=True) if d], "w string, d string", X.apply_edits(F.col("w"), F.col("d")))
    assert back == [m for (_, m), d in zip(rows, diff, strict=True) if d]


def test_deletions(spark):
    rows = [("ABCD", "BCD"), ("ABCD", "ABD"), ("ABCD", "ABC"), ("ABCD", "AB"), ("ABCD", "XXX"), ("AB", "ABCD")]
    assert run(spark, rows, "w string, m string", X.sequence_diff(F.col("w"), F.col("m"))) == ["A1del", "C3del", "D4del", None, "A1del", None]
    assert run(spark, rows, "w string, m string", X.sequence_diff(F.col("w"), F.col("m"), strict=True)) == ["A1del", "C3del", "D4del", None, None, None]


def test_edits_are_checked(spark):
    rows = [("ACD", "A1C,C1G"), ("ACD", "D9A"), ("ACD", "X2Y"), ("ACD", "C2E, D3F"), ("ACD", "junk"), ("ACD", "A0C")]
    assert run(spark, rows, "s string, e string", X.apply_edits(F.col("s"), F.col("e"))) == ["GCD", None, None, "AEF", None, None]


def test_codons(spark):
    assert run(spark, [("ATGAAA",), ("ATGXX",), ("",), ("TAAATGA",)], "x string", X.translate_codons(F.col("x"))) == ["MK", "M?", "", "*M?"]
    assert [X.codons_of(a)[0] for a in "ARNDCQEGHILKMFPSTWYV*"] == ["GCT", "CGT", "AAT", "GAT", "TGT", "CAA", "GAA", "GGT", "CAT", "ATT", "CTT", "AAA", "ATG", "TTT", "CCT", "TCT", "ACT", "TGG", "TAT", "GTT", "TAA"]
    got = run(spark, [("AAA", "K"), ("AAT", "T"), ("AAA", "W"), ("AAA", "?")], "c string, a string", X.codon_change(F.col("c"), F.col("a")))
    assert [g and tuple(g) for g in got] == [None, (1, "A", "C"), (0, "AAA", "TGG"), None]


def test_text_forms(spark):
    assert run(spark, [("PDB 1ABC_x",), ("a-b",), (None,)], "x string", X.normalise_id(F.col("x"))) == ["1abc", None, None]
    kv = run(spark, [("Score : 0.5",), ("Name: a:b",), ("none",)], "x string", X.key_value(F.col("x")))
    assert [k and tuple(k) for k in kv] == [("Score", "0.5", 0.5), ("Name", "a:b", None), None]
    assert run(spark, [(">id x\nAC\nGT\n",), (">only",)], "x string", X.fasta_sequence(F.col("x"))) == ["ACGT", ""]
    assert run(spark, [("ABC",)], "x string", X.spaced(F.col("x"))) == ["A B C"]


def brute_glocal(a, b):
    """The textbook recurrences with three matrices."""
    n, m, low = len(a), len(b), -1e9
    h = [[0.0] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]
    f = [[low] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i - 1][j] - 10, e[i - 1][j] - 1)
            f[i][j] = max(h[i][j - 1] - 10, f[i][j - 1] - 1)
            h[i][j] = max(h[i - 1][j - 1] + (5 if a[i - 1] == b[j - 1] else -4), e[i][j], f[i][j])
    return max([*h[n], *(r[m] for r in h)])


def test_alignment():
    r = random.Random(1)
    for _ in range(150):
        a, b = ("".join(r.choice("ACDE") for _ in range(r.randint(1, 12))) for _ in range(2))
        assert X.glocal_score(a, b)[0] == brute_glocal(a, b), (a, b)
    assert X.glocal_score("CDEF", "AACDEFGG") == (20.0, 2)
    assert X.glocal_score("AACDEFGG", "CDEF") == (20.0, -2)


def test_alignments_of_a_batch_are_those_of_each_pair(spark, monkeypatch):
    r = np.random.default_rng(8)
    texts = ["".join(r.choice(list("ACD\u00e9"), r.integers(0, 9))) for _ in range(600)] + ["A" * 40, "\U0001f600A"]
    a, b = texts[::2], texts[1::2]
    monkeypatch.setattr(X, "BLOCK", 150)
    scores, starts = X.glocal_scores(a, b)
    assert [(float(s), int(i)) for s, i in zip(scores, starts, strict=True)] == [X.glocal_score(x, y) for x, y in zip(a, b, strict=True)]
    assert all(s == (brute_glocal(x, y) if x and y else 0) for s, x, y in zip(scores[:120], a, b, strict=False))
    calls, plain = [], X.glocal_scores
    monkeypatch.setattr(X, "glocal_scores", lambda a, b: calls.append(len(a)) or plain(a, b))
    out = pd.concat(X.align_udf.func(iter([(pd.Series(["AC", None, "AC"] * 50), pd.Series(["A", "C", "A"] * 50))])))
    assert calls == [2] and out["score"].tolist() == [5.0, 0.0, 5.0] * 50  # equal pairs once, all at once


def test_align_udf(spark):
    got = run(spark, [("CDEF", "AACDEFGG"), (None, "A")], "a string, b string", X.align_udf(F.col("a"), F.col("b")))
    assert [tuple(g) for g in got] == [(20.0, 2), (0.0, 0)]


def test_context(spark):
    q = "MKTAYIAKQRQISFVKSHFSRQ"
    rows = [(q, "GG" + q, 10, 2), (q, "GGGG" + q, 10, 0), (q, "MMMM", 10, 0), (q, q, 0, 0)]
    assert run(spark, rows, "q string, t string, p int, o int", X.locate_context(F.col("q"), F.col("t"), F.col("p"), F.col("o"))) == [12, 14, None, 0]
