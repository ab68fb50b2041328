"""Sampling, leak-proof splits, numbering.

Random choices are orders by an MD5 of seed and key, so they do not depend on partitioning and can
be repeated in SQL. Caps are applied as ``row_number() <= cap``, which Spark turns into a limit
per group before the shuffle: a hot group sends at most cap rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *cols: str | Column) -> Column:
    """A pseudo-random text for each key."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)))


def ranked(df: DataFrame, keys: list[str], *order: str | Column, name: str = "_r") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ranked_by_draw(df: DataFrame, keys: list[str], seed: int, ids: list[str], name: str = "_r") -> DataFrame:
    """As ranked() by draws, numbered from 1: each group in 256 parts by the draw's first digits, which give its order, so a hot group is no single task's work."""
    parts = df.withColumn("_draw", draw(seed, *ids)).withColumn("_part", F.substring("_draw", 1, 2))
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).drop("_k")
    starts = starts.withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_part"]})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_part"]))
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_draw", *ids))
    return parts.withColumn(name, nth).join(starts, same).withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def head_per_group(df: DataFrame, keys: list[str], n: int, *order: str | Column) -> DataFrame:
    """The first n rows of each group."""
    return ranked(df, keys, *order).filter(F.col("_r") <= n).drop("_r")


def sample_cap(df: DataFrame, keys: list[str], ids: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """At most n rows of each group, without replacement; smaller groups stay whole."""
    return head_per_group(df, keys, n, draw(seed, *ids), *ids)


def balanced_sample(df: DataFrame, target: str, active: str, ids: list[str], cap: int | float | None, seed: int = 42, scaffold: str | None = None) -> DataFrame:
    """Actives up to a cap (int: without replacement; float: that share, with replacement), and at most as many inactives.

    With a scaffold column, and an int, one active of each scaffold is preferred. None passes all rows on.
    Otherwise rows whose active is null are neither and are left out; rows of a null target are a target of their own.
    """
    if cap is None:
        return df
    actives, inactives = df.filter(F.col(active)), df.filter(~F.col(active))
    counts = actives.groupBy(target).agg(F.count("*").alias("_n"))
    if isinstance(cap, float):
        counts = counts.withColumn("_take", F.floor(F.col("_n") * cap).cast("long"))
        numbered = ranked_by_draw(actives, [target], seed, ids, name="_pos")
        draws = counts.filter("_take > 0").select(target, "_n", F.explode(F.sequence(F.lit(1).cast("long"), "_take")).alias("_k"))
        picked = draws.select(target, (F.pmod(F.xxhash64(F.lit(seed), target, "_k"), F.col("_n")) + 1).alias("_pos"))
        picked = picked.withColumnsRenamed({target: "_of_t", "_pos": "_at"})
        chosen = numbered.join(picked, F.col(target).eqNullSafe(F.col("_of_t")) & (F.col("_pos") == F.col("_at"))).select(*df.columns)
        quota = ranked_by_draw(inactives, [target], seed + 1, ids)
    else:
        counts = counts.withColumn("_take", F.least(F.col("_n"), F.lit(cap)).cast("long"))
        order = [draw(seed, *ids), *ids]
        if scaffold:
            first = F.row_number().over(Window.partitionBy(target, scaffold).orderBy(*ids))
            actives = actives.withColumn("_rest", (first > 1).cast("int"))
            order = ["_rest", *order]
        chosen = head_per_group(actives, [target], cap, *order).select(*df.columns)
        quota = ranked(inactives, [target], draw(seed + 1, *ids), *ids).filter(F.col("_r") <= cap)
    takes = counts.select(F.col(target).alias("_of_t"), "_take")
    matched = quota.join(takes, F.col(target).eqNullSafe(F.col("_of_t"))).filter(F.col("_r") <= F.col("_take")).select(*df.columns)
    return chosen.unionByName(matched)


def scaffold_split(df: DataFrame, target: str, scaffold: str, ids: list[str], test_size: float = 0.2) -> DataFrame:
    """side: test, train, or dropped.

    Scaffolds go to test by ascending size (then by first appearance in the order of ids) while test has fewer than
    int(n * test_size) rows, at least 1. Targets of fewer than 3 rows, or with an empty side, are all train. Rows with an
    empty scaffold go to neither side otherwise. Rows of a null target are a target of their own. Running sums are over scaffolds, not rows.
    """
    sizes = df.groupBy(target, scaffold).agg(F.count("*").alias("_k"), F.min(F.struct(*ids)).alias("_first"))
    real = F.coalesce(F.col(scaffold) != "", F.lit(False))
    whole = Window.partitionBy(target)
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(target, real).orderBy("_k", "_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    test = F.when(real, F.col("_before") < F.greatest(F.floor(F.col("_n") * test_size), F.lit(1)))
    placed = sizes.withColumns({"_n": F.sum("_k").over(whole), "_before": before}).withColumn("_test", test)
    sides = F.when((F.col("_n") < 3) | (F.count_if("_test").over(whole) == 0) | (F.count_if(~F.col("_test")).over(whole) == 0), "train")
    placed = placed.select(F.col(target).alias("_of_t"), F.col(scaffold).alias("_of_s"), sides.when(F.col("_test").isNull(), "dropped").when(F.col("_test"), "test").otherwise("train").alias("side"))
    return df.join(placed, F.col(target).eqNullSafe(F.col("_of_t")) & F.col(scaffold).eqNullSafe(F.col("_of_s"))).select(*df.columns, "side")


@dataclass
class Level:
    k: int
    from_k: int
    test: DataFrame
    train: DataFrame

    @property
    def name(self) -> str:
        """The provenance name: k<n>, with the level it repeats where it could not be split."""
        return f"k{self.k}" + (f"_from_k{self.from_k}" if self.from_k != self.k else "")


def culling_split(df: DataFrame, target: str, levels: list[int], output: set[int], n_folds: int = 5, seed: int = 42, split: int = 1, column: str = "k{}_cluster") -> Iterator[Level]:
    """Hold out whole clusters level by level; each level works on what the last left for training.

    A level with one cluster repeats the last split. Per level a count of clusters is read; the clusters held out are
    chosen in the plan, by order of their draws. Lineage is cut with a checkpoint at each level.
    """
    from quartzloom.session import cut

    pool, last = df, None
    for k in levels:
        c = column.format(k)
        clusters = pool.select(c).filter(F.col(c).isNotNull()).distinct()
        n = clusters.count()
        if n > 1:
            held = clusters.orderBy(draw(seed + split - 1, F.lit(k), F.col(c)), c).limit(max(1, n // n_folds))
            test = cut(pool.join(held, c, "left_semi").select(*df.columns))
            pool = cut(pool.join(test.select(target).distinct(), target, "left_anti").select(*df.columns))
            last = (k, test, pool)
        if k in output and last:
            yield Level(k, *last)


def stratified_group_folds(df: DataFrame, group: str, label: str, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, fold): whole groups to folds, with class shares kept close.

    Groups with equal class counts are interchangeable, so only the number of groups for each pair of counts is read to
    the driver and dealt: full rounds evenly, the rest each to the fold whose class shares it evens out most.
    """
    per = df.groupBy(group).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_q"))
    profiles = sorted(((r["_p"], r["_q"], r["n"]) for r in per.groupBy("_p", "_q").agg(F.count("*").alias("n")).collect()), key=lambda r: (-abs(r[0] - r[1]), -r[0] - r[1], r[0]))
    total_p, total_q = max(1, sum(p * n for p, _, n in profiles)), max(1, sum(q * n for _, q, n in profiles))
    load, plan = [[0, 0] for _ in range(n_folds)], []

    def spread(f: int, p: int, q: int) -> tuple[float, int]:
        shares = [((a + p * (i == f)) / total_p, (b + q * (i == f)) / total_q) for i, (a, b) in enumerate(load)]
        var = sum(sum((s[j] - sum(x[j] for x in shares) / n_folds) ** 2 for s in shares) for j in (0, 1))
        return var, load[f][0] + load[f][1]

    for p, q, n in profiles:
        quota = [n // n_folds] * n_folds
        for f in range(n_folds):
            load[f][0] += p * quota[f]
            load[f][1] += q * quota[f]
        for _ in range(n % n_folds):
            f = min(range(n_folds), key=lambda i: (*spread(i, p, q), i))
            quota[f] += 1
            load[f][0] += p
            load[f][1] += q
        at = 0
        for f, k in enumerate(quota):
            if k:
                plan.append((p, q, at, at + k, f))
            at += k
    table = df.sparkSession.createDataFrame(plan or [(0, 0, 0, 0, 0)], "_p long, _q long, _lo long, _hi long, fold int")
    numbered = ranked_by_draw(per, ["_p", "_q"], seed, [group])  # very many groups may have one positive and no negative
    return numbered.join(F.broadcast(table), ["_p", "_q"]).filter((F.col("_r") > F.col("_lo")) & (F.col("_r") <= F.col("_hi"))).select(group, "fold")


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if not a.select(key).intersect(b.select(key)).isEmpty():
        raise AssertionError(f"splits share values of {key}")


def permute_labels(df: DataFrame, group: str, label: str, ids: list[str], seed: int = 42) -> DataFrame:
    """label replaced by another row's of the same group: a random permutation of the rows of each group.

    ids tell rows apart. The row that comes n-th by one draw gets the label of the row that comes n-th by another.
    """
    to = ranked_by_draw(df, [group], seed, ids, name="_pos")
    of = ranked_by_draw(df.select(group, label, *(c for c in ids if c not in (group, label))), [group], seed + 1, ids, name="_nth").select(F.col(group).alias("_of"), "_nth", F.col(label).alias("_new"))
    return to.join(of, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_pos") == F.col("_nth"))).withColumn(label, F.col("_new")).select(*df.columns)


def subset(df: DataFrame, n: int, ids: list[str], seed: int = 42) -> DataFrame:
    """min(n, rows) rows, by a top-n of draws."""
    return df.withColumn("_d", draw(seed, *ids)).orderBy("_d", *ids).limit(n).drop("_d")


def number_rows(df: DataFrame, *order: str | Column, name: str = "index") -> DataFrame:
    """A dense index from 0 in an explicit order, by ranges: no task holds all rows."""
    from quartzloom.session import cut

    rows = cut(df.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    starts, at = [], 0
    for p, n in sorted((r["_p"], r["n"]) for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect()):  # a row a partition
        starts.append((p, at))
        at += n
    table = df.sparkSession.createDataFrame(starts or [(0, 0)], "_p int, _s long")
    return rows.join(F.broadcast(table), "_p").withColumn(name, F.col("_s") + F.col("_m")).drop("_p", "_m", "_s")


def chunks(df: DataFrame, size: int, *order: str | Column) -> DataFrame:
    """chunk: from 1, of `size` rows in order."""
    return number_rows(df, *order, name="_i").withColumn("chunk", F.floor(F.col("_i") / size) + 1).drop("_i")
