"""The divergence audit against sums over all terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quartzloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def slow(rows, least=10, top=10):
    """rows: (lang, source, text)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((x or "" for x in r) for r in rows):
        words = TERM.findall(text.translate(LOWER))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        of[None] = {t: sum(of[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 1_000_000_000 * (n + 2) // (sum(c.values()) + 2 * v) for t, n in c.items()} for s, c in of.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o, "pair") for o in sources - {s}]
            terms = [(f(p[s][t], p[None][t]), t, "term") for t in kept if of[s][t] and p[s][t] > p[None][t]]
            for found, most in ((pairs, len(pairs)), (terms, top)):
                for k, (value, item, part) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=400):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "a" * 40, *("".join(r.choice("abcdeéß") for _ in range(3)) for _ in range(60))]
    rows = []
    for _ in range(n):
        lang, source = r.choice(["en", "en", "de", None, ""]), r.choice(["s0", "s0", "s1", "s2", "é", "z", None])
        text = r.choice([None, "", "1 2 \x00 3", *(" ".join(r.choices(words[: r.choice([8, 66])], k=r.randint(1, 60))) + r.choice(["", "\x85", ".\n|x"]) for _ in range(8))])
        rows.append((lang, source, text))
    return rows + rows[:5] * 3 + [("xx", "only", "alone"), ("yy", "a", "one two"), ("yy", "b", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "lang string, source string, text string, n long, term string").repartition(5)
    assert got(divergence.audit(docs, shards=7)) == slow(rows)
    assert got(divergence.audit(docs, least=1, top=2)) == slow(rows, 1, 2)


def test_long_texts_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    text = "ab " * 40 + "c" * 200 + " d"
    assert len(divergence.pieces(text)) > 2 and [w for x in divergence.pieces(text) for w in x.split()] == text.split()
    r = random.Random(3)
    rows = [("en", f"s{i % 3}", " ".join(r.choice(["aa", "bb", "cc", "é" * 70]) for _ in range(r.randint(0, 200)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(divergence.audit(docs)) == slow(rows)


def test_empty_and_joined(spark, monkeypatch):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert got(divergence.audit(docs)) == set()
    monkeypatch.setattr(divergence.common, "BROADCAST_ROWS", 0)
    rows = corpus(5, 100)
    assert got(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"))) == slow(rows)


def test_great_counts(spark):
    """Counts beyond what a product with 10^9 holds in 64 bits."""
    big = 1 << 40
    cells = [[("a", big, big + 5), ("b", 3, 7)], [("a", 5, big + 5), ("b", 4, 7)]]
    kept = spark.createDataFrame([("en", f"t{i}", c, 2, big + 12) for i, c in enumerate(cells)], "lang string, term string, cells array<struct<source:string,n:long,total:long>>, v long, n_lang long")
    p = lambda n, total: 1 + 1_000_000_000 * (n + 2) // (total + 4)
    f = lambda x, y: (x - y) ** 2 // (x + y)
    a, b, za, zb = [p(big, big + 5), p(5, big + 5)], [p(3, 7), p(4, 7)], p(0, big + 5), p(0, 7)
    (row,) = divergence.shard_sums(kept).filter("part = 'pair'").groupBy("source", "item").agg(F.sum("value").alias("v")).collect()
    assert row["v"] == sum(f(x, y) - f(x, zb) - f(za, y) + f(za, zb) for x, y in zip(a, b, strict=True))
    one = spark.range(1).select(divergence.share(F.lit(big), F.lit(big + 5), F.lit(2).cast("long")).alias("p")).first()
    assert one["p"] == a[0]
