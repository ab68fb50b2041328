"""The index of the pipeline's near stage against sets of words, all pairs compared."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_fingerprint

from quartzloom.llm import common, resemblance


def brute_set(text):
    words = [w for w in "".join(c if c not in "\t\n\v\f\r" else " " for c in text or "").split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def near_classes(texts):
    """By both kinds of links."""
    found, prints = [brute_set(t) for t in texts], [brute_fingerprint(t) for t in texts]
    group = brute_components(prints)
    return classes(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if group[prints[i]] == group[prints[j]] or 5 * len(found[i] & found[j]) >= 4 * len(found[i] | found[j])])


def copies(seed, groups, each, words=120, changes=5):
    r, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(words)]
        for _ in range(each):
            text = list(base)
            for at in r.sample(range(words), r.randrange(changes)):
                text[at] = f"x{r.randrange(10**6)}"
            out.append(" ".join(text))
    return out


def nodes_of(df):
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk")).alias("rep")
    return common.cut(resemblance.prints(df).groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), least))


@pytest.mark.parametrize(("block", "volume"), [(1024, 1 << 20), (7, 1 << 20), (1024, 900)])
def test_links_whatever_the_blocks(spark, block, volume):
    texts = copies(5, 3, 40) + copies(6, 60, 2) + [f"alone {i} " * 9 for i in range(30)]
    sets = [brute_set(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    nodes = nodes_of(df)
    doc = {r["node"]: r["rep"]["doc_id"] for r in nodes.collect()}
    links = [(doc[a], doc[b]) for a, b in resemblance.jaccard_links(df, nodes, block, volume).collect()]
    assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in links)  # every link is exact
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    got = classes(len(texts), links + [(i, j) for i, j in pairs if sets[i] == sets[j]])
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)
    assert len(set(map(frozenset, links))) < len(pairs) / 2  # a forest for each list, not all pairs


def test_keep_first(spark):
    texts = [None, "", " \n\t", "one", "One", "one two three", *copies(1, 12, 6), *copies(2, 20, 1), "é ſ K " * 8]
    rows = [(None if i == 8 else i, t) for i, t in enumerate(texts)] + [(9, texts[9])] * 3
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    kept = resemblance.keep_first(df)
    group = near_classes(texts)
    least = defaultdict(list)
    for i, g in enumerate(group):
        least[g].append(i)
    want = Counter(next((i for i in g if i != 8), None) for g in least.values())
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert resemblance.keep_first(df.filter("false")).count() == 0
    common.release(spark)


def test_sets_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(copies(3, 10, 4))), "doc_id int, text string")
    want = Counter(map(tuple, resemblance.keep_first(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, resemblance.keep_first(df).collect())) == want
    common.release(spark)


def test_very_long_texts(spark):
    long = " ".join(f"w{i * i % 99991}" for i in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long.replace("w25 ", "other ", 1)), (3, "lorem ipsum " * 500_000), (4, "something else")], "doc_id int, text string")
    assert sorted(r["doc_id"] for r in resemblance.keep_first(df).select("doc_id").collect()) == [1, 3, 4]
    common.release(spark)


def test_recall(spark):
    """Over real tables: of the pairs of different sets at 0.8 or more, at least 0.9 are in one class."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r["doc_id"]: brute_set(r["text"]) for r in rows if len((r["text"] or "").split()) >= 20}
    lists = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    pairs = {p for found in lists.values() for p in combinations(sorted(found), 2)}
    pairs = [(a, b) for a, b in pairs if sets[a] != sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    nodes = nodes_of(df)
    found = {r["doc_id"]: r["node"] for r in resemblance.prints(df).select("doc_id", "node").collect()}
    component = {r["node"]: r["component"] for r in resemblance.connected_components(resemblance.jaccard_links(df, nodes)).collect()}
    hit = sum(component.get(found[a], found[a]) == component.get(found[b], found[b]) for a, b in pairs)
    print("pairs", len(pairs), "found", hit)
    assert pairs and hit >= 0.9 * len(pairs)
