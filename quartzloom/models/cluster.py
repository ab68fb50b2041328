"""Scaling, PCA, k-means and Ward hierarchies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.functions.vectors import zscore
from quartzloom.operators.aggregates import vector_moments
from quartzloom.operators.joins import nearest
from quartzloom.session import cut, discard, stored


def standard_scale(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Each place to mean 0 and population std 1 (std 0: left at 0). One row of moments is broadcast."""
    row = vector_moments(df, vector).select(F.col("mean").alias("_m"), F.col("std").alias("_d"))
    return df.join(F.broadcast(row)).withColumn(out, zscore(F.col(vector), F.col("_m"), F.col("_d"))).drop("_m", "_d")


def pca_share(df: DataFrame, vector: str, out: str, share: float = 0.95) -> DataFrame:
    """Scaled vectors projected on the fewest principal components that explain a share of the variance."""
    z = standard_scale(df, vector, "_z").withColumn("_f", array_to_vector("_z"))
    d = z.select(F.size("_z")).first()[0]
    model = PCA(k=d, inputCol="_f", outputCol="_p").fit(z)
    k = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), share) + 1)
    return model.transform(z).withColumn(out, F.slice(vector_to_array("_p"), 1, min(k, d))).drop("_z", "_f", "_p")


def kmeans(df: DataFrame, vector: str, k: int, starts: int = 10, max_iter: int = 100, seed: int = 42, random_init: bool = False):
    """The model of least cost of several starts."""
    data = df.withColumn("_f", array_to_vector(vector)).select("_f").persist()
    try:
        make = lambda i: KMeans(k=k, featuresCol="_f", predictionCol="cluster", seed=seed + i, maxIter=max_iter, initMode="random" if random_init else "k-means||").fit(data)
        return min((make(i) for i in range(starts)), key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()


def assign(df: DataFrame, vector: str, model) -> DataFrame:
    """df with its cluster."""
    return model.transform(df.withColumn("_f", array_to_vector(vector))).drop("_f")


def representatives_of(df: DataFrame, ids: str, vector: str, k: int, share: float = 0.95, starts: int = 10) -> DataFrame:
    """(cluster, id): the point nearest to each centre of k-means on the reduced vectors."""
    z = pca_share(df, vector, "_r", share)
    model = kmeans(z, "_r", k, starts)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centres = df.sparkSession.createDataFrame(rows, "centre_id int, centre array<double>")
    return nearest(z, centres, ids, "_r").select(F.col("centre_id").alias("cluster"), ids)


def ward(x: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of Ward linkage in order of height; new clusters are numbered from n. sizes: points at each centre (1).

    Nearest-neighbour chain on centroids: memory grows with the points, time with their square.
    """
    n = len(x)
    if n < 2:
        return []
    centre, size, ids, alive = np.array(x, float), np.ones(n) if sizes is None else np.array(sizes, float), np.arange(n), np.ones(n, bool)
    square, chain, links, found = (centre * centre).sum(1), [], [], []
    for left in range(n, 1, -1):
        if left < len(ids) // 2:  # merged slots are left out from here on
            place = np.cumsum(alive) - 1
            chain = [int(place[c]) for c in chain]
            centre, size, ids, square, alive = centre[alive], size[alive], ids[alive], square[alive], alive[alive]
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            d = 2 * size[a] * size / (size[a] + size) * np.maximum(square + square[a] - 2 * (centre @ centre[a]), 0)
            d[~alive] = d[chain] = np.inf  # links get shorter, so none but the last can be nearest: rounding makes no circle
            b = int(d.argmin())
            if links and links[-1] <= d[b]:
                b = chain[-2]
                break
            chain.append(b)
            links.append(d[b])
        del chain[-2:]
        del links[-2:]
        a, b = (a, b) if ids[a] < ids[b] else (b, a)
        gap = centre[a] - centre[b]
        found.append((int(ids[a]), int(ids[b]), float(np.sqrt(2 * size[a] * size[b] / (size[a] + size[b]) * (gap * gap).sum()))))
        centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        square[a] = (centre[a] ** 2).sum()
        size[a] += size[b]
        alive[b] = False
    # by height, renumbered: each slot leads to the cluster that its members are in by then
    up, name, out = list(range(n)), list(range(n)), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for step, (a, b, h) in enumerate(sorted(found, key=lambda m: m[2])):
        a, b = root(a), root(b)
        out.append((min(name[a], name[b]), max(name[a], name[b]), h))
        up[b], name[a] = a, n + step
    return out


def cuts(merges: list[tuple[int, int, float]], n: int, most: int) -> np.ndarray:
    """Labels (from 1) of each point when cut into k = 2 .. most clusters: n rows. Labels of a level are by first appearance."""
    members = {i: [i] for i in range(n)}
    states = {n: list(members.values())}
    for step, (a, b, _) in enumerate(merges):
        members[n + step] = members.pop(a) + members.pop(b)
        if n - step - 1 <= most:
            states[n - step - 1] = list(members.values())
    out = np.zeros((n, max(0, most - 1)), int)
    for k in range(2, most + 1):
        for label, group in enumerate(sorted(states[min(k, n)], key=min), 1):
            out[list(group), k - 2] = label
    return out


#: Clusters up to which one worker ends a linkage: memory for their centres, time that grows with their square.
LAST = 4_000
#: Clusters in a block of a search; a task of a search holds two blocks.
BLOCK = 8_192
#: Entries of a distance matrix held at a time.
CELLS = 1_000_000


#: Clusters in a block of those that search, at least, where there are tasks to spare.
ASKED = 512


def packed(clusters: DataFrame, count: int, least: int = 1) -> DataFrame:
    """(k, n, c) of clusters as bytes, in blocks of about BLOCK, or in so many blocks at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        pdf = pd.concat(rows).sort_values("k")
        for s in range(0, len(pdf), BLOCK):
            part = pdf.iloc[s : s + BLOCK]
            yield pd.DataFrame({"k": [part["k"].to_numpy(np.int64).tobytes()], "n": [part["n"].to_numpy(float).tobytes()], "c": [np.array(part["c"].tolist(), float).tobytes()]})

    return cut(clusters.select("k", "n", "c").repartition(max(least, -(-count // BLOCK)), "k").mapInPandas(run, "k binary, n binary, c binary"))


def nearest_clusters(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(k, near, d): for each cluster of the blocks asked, the nearest of the others; of equal ones that of the least k. Each pair of blocks is one row's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qk, k = np.frombuffer(r.qk, np.int64), np.frombuffer(r.k, np.int64)
                qn, n = np.frombuffer(r.qn), np.frombuffer(r.n)
                qx, x = np.frombuffer(r.qc).reshape(len(qk), -1), np.frombuffer(r.c).reshape(len(k), -1)
                # squared heights of merges: 2 |q - x|^2 / (1 / qn + 1 / n), the squares of the centres as two more places
                left = np.c_[-4 * qx, np.full(len(qk), 2.0), 2 * (qx * qx).sum(1)]
                right = np.c_[x, (x * x).sum(1), np.ones(len(k))].T
                step = max(1, CELLS // len(k))
                for s in range(0, len(qk), step):
                    d = left[s : s + step] @ right
                    d /= 1 / qn[s : s + step, None] + 1 / n
                    at = np.searchsorted(k, qk[s : s + step]).clip(0, len(k) - 1)
                    own = np.flatnonzero(k[at] == qk[s : s + step])
                    d[own, at[own]] = np.inf
                    best = d.argmin(1)
                    out = pd.DataFrame({"k": qk[s : s + step], "near": k[best], "d": np.maximum(d[np.arange(len(best)), best], 0)})
                    yield out[np.isfinite(out["d"])]

    pairs = asked.select(F.col("k").alias("qk"), F.col("n").alias("qn"), F.col("c").alias("qc")).crossJoin(blocks.hint("shuffle_replicate_nl"))
    found = pairs.mapInPandas(run, "k long, near long, d double")
    return found.groupBy("k").agg(F.min(F.struct("d", "near")).alias("m")).select("k", "m.near", "m.d")


def merged(clusters: DataFrame, last: int) -> list[DataFrame]:
    """(k, lost, h, round): the merges of Ward linkage of clusters (k, c, n, h): key, centre, size, height of the last merge. Cluster k takes in the cluster lost, no larger than itself, at height h.

    In a round, clusters that are the nearest of each other merge, all at once: they merge in any order, as no merge
    brings a cluster nearer to others than its parts were. For the same reason only new clusters and those whose nearest
    is gone search again, against all, in blocks. From ``last`` clusters on one worker does the rest.
    """
    spark = clusters.sparkSession
    tasks = spark.sparkContext.defaultParallelism  # unions would have more partitions each round
    s, path = stored(clusters.select("*", F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("d")).coalesce(tasks))
    count, out = s.count(), []
    while count > last:
        stale = s.filter("near is null")
        asking = stale.count()
        blocks = packed(s, count)
        spare = -(-2 * tasks // -(-count // BLOCK))  # a pair of blocks is a task
        asked = packed(stale, asking, min(spare, -(-asking // ASKED)))
        found = nearest_clusters(asked, blocks)
        s, old = cut(s.filter("near is not null").unionByName(stale.drop("near", "d").join(found, "k")).coalesce(tasks)), path
        other = s.select(*(F.col(c).alias(f"{c}_") for c in s.columns))
        pairs = s.join(other, (F.col("near") == F.col("k_")) & (F.col("k") == F.col("near_"))).filter("n > n_ or n = n_ and k < k_")
        share = F.zip_with("c", "c_", lambda a, b: (a * F.col("n") + b * F.col("n_")) / (F.col("n") + F.col("n_")))
        gap = F.aggregate(F.zip_with("c", "c_", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
        height = F.greatest("h", "h_", F.sqrt(2 * F.col("n") * F.col("n_") / (F.col("n") + F.col("n_")) * gap))  # never below that of its parts
        columns = ["k", F.col("k_").alias("lost"), share.alias("c"), (F.col("n") + F.col("n_")).alias("n"), height.alias("h")]
        new = cut(pairs.select(*columns).coalesce(tasks))
        fewer = new.count()
        if not fewer:  # rounding has made a circle of equal distances: the closest pair merges
            first = s.orderBy("d", "k").limit(1).join(other, F.col("near") == F.col("k_"))
            new, fewer = cut(first.select(*columns)), 1
        out.append(new.select("k", "lost", "h", F.lit(len(out) + 1).cast("long").alias("round")))
        gone = new.select("k").union(new.select("lost"))
        kept = s.join(gone, "k", "left_anti").join(gone.select(F.col("k").alias("near"), F.lit(True).alias("_gone")), "near", "left")
        kept = kept.select("k", "c", "n", "h", F.when(F.col("_gone").isNull(), F.col("near")).alias("near"), "d")
        s, path = stored(kept.unionByName(new.select("k", "c", "n", "h", F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("d"))).coalesce(tasks))
        discard(spark, old)
        count -= fewer
    done = len(out)

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        keys, size, low = pdf["k"].tolist(), pdf["n"].tolist(), pdf["h"].tolist()
        rows = []
        for step, (a, b, h) in enumerate(ward(np.array(pdf["c"].tolist(), float), pdf["n"].to_numpy(float))):
            a, b = (a, b) if size[a] >= size[b] else (b, a)
            low.append(max(h, low[a], low[b]))
            size.append(size[a] + size[b])
            keys.append(keys[a])
            rows.append((keys[a], keys[b], low[-1], done + 1 + step))
        return pd.DataFrame(rows, columns=["k", "lost", "h", "round"]).astype({"k": "int64", "lost": "int64", "h": float, "round": "int64"})

    out.append(cut(s.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda pdf: end(pdf), "k long, lost long, h double, round long")))
    discard(spark, path)
    return out


def hierarchy_paths(df: DataFrame, ids: str, vector: str, most: int = 5000, last: int = LAST) -> DataFrame:
    """(id, path): cluster labels at k = 2 .. most of Ward linkage on scaled vectors, by first appearance in the order of ids.

    Time grows with the square of the different vectors, spread over the tasks; a task holds two blocks of clusters, and
    the driver only the highest ``most`` merges.
    """
    rows = cut(standard_scale(df, vector, "_z").select(F.col(ids).alias("id"), F.col("_z").alias("c"), F.xxhash64(F.monotonically_increasing_id()).alias("k")))
    if not rows.filter(F.col("c").isNull() | F.exists("c", lambda x: x.isNull() | F.isnan(x))).isEmpty():
        raise ValueError("a vector is missing or has missing places")
    n = rows.count()
    most = min(most, n)
    if most < 2:
        return rows.select(F.col("id").alias(ids), F.array().cast("array<int>").alias("path"))
    alike = cut(rows.groupBy("c").agg(F.min("k").alias("k"), F.count("*").cast("double").alias("n")))
    copies = rows.join(alike.select("c", F.col("k").alias("of")), "c").filter("k <> of").select(F.col("of").alias("k"), F.col("k").alias("lost"), F.lit(0.0).alias("h"), F.lit(0).cast("long").alias("round"))
    merges, merges_at = stored(reduce(DataFrame.unionByName, merged(alike.select("k", "c", "n", F.lit(0.0).alias("h")), last), copies))
    # without the highest merges, which no other merge follows, there are ``most`` clusters
    top = merges.orderBy(F.desc("h"), F.desc("round"), "k", "lost").limit(most - 1).collect()
    cut_off = df.sparkSession.createDataFrame([(r["lost"],) for r in top], "lost long")
    up = merges.join(F.broadcast(cut_off), "lost", "left_anti").select(F.col("lost").alias("k"), F.col("k").alias("root"))
    roots, at = stored(rows.select("id", "k").join(up, "k", "left").withColumn("root", F.coalesce("root", "k")))
    discard(df.sparkSession, merges_at)
    while True:  # a cluster is at most half of what takes it in, so few steps lead to the root
        further, old = roots.select(F.col("k").alias("root"), F.col("root").alias("_next")), at
        roots, at = stored(roots.join(further, "root").select("id", "k", F.col("_next").alias("root"), (F.col("root") != F.col("_next")).alias("_moved")))
        discard(df.sparkSession, old)
        if roots.filter("_moved").isEmpty():
            break
    roots = cut(roots.select("id", "k", "root"))
    discard(df.sparkSession, at)
    order = [r["root"] for r in roots.groupBy("root").agg(F.min(F.struct("id", "k")).alias("_first")).orderBy("_first").select("root").collect()]
    name, found = {root: i for i, root in enumerate(order)}, []
    for step, r in enumerate(reversed(top)):
        found.append((name[r["k"]], name.pop(r["lost"]), r["h"]))
        name[r["k"]] = most + step
    paths = [(root, [int(v) for v in path]) for root, path in zip(order, cuts(found, most, most), strict=True)]
    return roots.join(F.broadcast(df.sparkSession.createDataFrame(paths, "root long, path array<int>")), "root").select(F.col("id").alias(ids), "path")
