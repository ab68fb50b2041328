"""Support vector machines of pairs, fitted on all pairs over the cluster.

The dual problem, in signed multipliers m = alpha y: least m K m / 2 - y m with sum(m) = 0 and m between 0 and C y. In a
round the pairs are dealt in parts. Each part moves its own multipliers by pairwise steps, chunk after chunk, all parts at
once. What the moves of a part do to the scores of all others is then computed, two parts a task, and a small problem of
the same form tells how far each group of moves (part, right side, sign) is to be gone, so that moves of many parts
do not add up to too much. Rounds end when the duality gap is small; every kernel value is the exact one.

A task holds two parts of PART pairs and a slice of CELLS kernel values. Time of a round grows with the square of the
pairs by the kernel, and with their number by the linear model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.models import svm
from quartzloom.session import cut, discard, stored

#: Pairs of a part at most (about), and at least where there is more than one.
PART, LEAST = 16_384, 2_048
#: Pairs whose kernel matrix a worker holds.
CHUNK = 1_024
#: Kernel values held at a time.
CELLS = 250_000
#: Right sides are in so many groups at most, by hash.
GROUPS = 24
#: Different (right side, group) up to which left kernels are summed before they meet right ones.
COLUMNS = 128


class Block(NamedTuple):
    """Pairs (li, ri) of the rows of two tables of different vectors."""

    left: np.ndarray
    right: np.ndarray
    li: np.ndarray
    ri: np.ndarray


class Moves(NamedTuple):
    """For each pair of a block its group and its share of the group's move."""

    group: np.ndarray
    share: np.ndarray
    count: int

    def table(self) -> np.ndarray:
        out = np.zeros((len(self.group), self.count))
        out[np.arange(len(self.group)), self.group] = self.share
        return out


def gram(a: Block, b: Block, gammas: list[float] | None) -> np.ndarray:
    """Kernel values of the pairs of two blocks: the product of two kernels, or without gammas the product of concatenated vectors."""
    if gammas is None:
        return (a.left @ b.left.T)[np.ix_(a.li, b.li)] + (a.right @ b.right.T)[np.ix_(a.ri, b.ri)]
    return svm.rbf_matrix(a.left, b.left, gammas[0])[np.ix_(a.li, b.li)] * svm.rbf_matrix(a.right, b.right, gammas[1])[np.ix_(a.ri, b.ri)]


def rbf_rows(x: np.ndarray, y: np.ndarray, gamma: float) -> Callable[[np.ndarray | slice], np.ndarray]:
    """A function of rows of x: their kernel values with y. The squares are two more places of the vectors, as in one product."""
    left = np.c_[2 * gamma * x, np.ones(len(x)), -gamma * (x * x).sum(1)]
    right = np.c_[y, -gamma * (y * y).sum(1), np.ones(len(y))].T

    def run(rows: np.ndarray | slice) -> np.ndarray:
        k = left[rows] @ right
        return np.exp(np.minimum(k, 0, out=k), out=k)

    return run


def taken(b: Block, at: np.ndarray) -> Block:
    """The pairs at some places, with the vectors they use."""
    l, li = np.unique(b.li[at], return_inverse=True)
    r, ri = np.unique(b.ri[at], return_inverse=True)
    return Block(b.left[l], b.right[r], li, ri)


def effects(a: Block, ma: Moves, b: Block, mb: Moves, gammas: list[float] | None) -> tuple[np.ndarray, np.ndarray]:
    """What the groups of b do to the scores of a, and those of a to b: (pairs of a, groups of b), (pairs of b, groups of a)."""
    if gammas is None:
        weights = [[t.T @ np.stack([np.bincount(i, w, len(t)) for w in m.table().T], 1) for t, i in ((x.left, x.li), (x.right, x.ri))] for x, m in ((a, ma), (b, mb))]
        return tuple((x.left @ wl)[x.li] + (x.right @ wr)[x.ri] for x, (wl, wr) in ((a, weights[1]), (b, weights[0])))
    kr, kl = svm.rbf_matrix(a.right, b.right, gammas[1]), rbf_rows(a.left, b.left, gammas[0])
    columns = [np.unique(x.ri * m.count + m.group, return_inverse=True) for x, m in ((a, ma), (b, mb))]
    if max(len(c) for c, _ in columns) > COLUMNS:
        ta, tb, first, second = ma.table(), mb.table(), [], np.zeros((len(b.li), ma.count))
        step = max(1, CELLS // max(1, len(b.li)))
        for s in range(0, len(a.li), step):
            k = kl(a.li[s : s + step])[:, b.li] * kr[a.ri[s : s + step]][:, b.ri]
            first.append(k @ tb)
            second += k.T @ ta[s : s + step]
        return np.concatenate(first), second
    sums = [np.bincount(x.li * len(c) + at, m.share, len(x.left) * len(c)).reshape(len(x.left), -1) for x, m, (c, at) in ((a, ma, columns[0]), (b, mb, columns[1]))]
    first, second, step = [], np.zeros((len(b.left), sums[0].shape[1])), max(1, CELLS // max(1, len(b.left)))
    for s in range(0, len(a.left), step):
        k = kl(slice(s, s + step))
        first.append(k @ sums[1])
        second += k.T @ sums[0][s : s + step]
    out = []
    for x, m, c, t, right in ((a, mb, columns[1][0], np.concatenate(first), kr), (b, ma, columns[0][0], second, kr.T)):
        of = np.zeros((len(c), m.count))
        of[np.arange(len(c)), c % m.count] = 1
        out.append((t[x.li] * right[x.ri][:, c // m.count]) @ of)
    return out[0], out[1]


def descend(k: np.ndarray, e: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray, tol: float, steps: int) -> np.ndarray:
    """Multipliers m, moved in twos until no two differ by tol. e: targets less scores."""
    m, e, diag = m.copy(), e.copy(), np.diag(k).copy()
    for _ in range(steps):
        up = np.where(m < high - 1e-12 * np.abs(high), e, -np.inf)
        i = int(up.argmax())
        gap = np.where(m > low + 1e-12 * np.abs(low), up[i] - e, -np.inf)
        if not gap.max() > tol:
            break
        curve = np.maximum(diag[i] + diag - 2 * k[i], 1e-12)
        j = int(np.where(gap > 0, gap * gap / curve, -1).argmax())
        move = min(gap[j] / curve[j], high[i] - m[i], m[j] - low[j])
        m[i] = high[i] if move == high[i] - m[i] else m[i] + move
        m[j] = low[j] if move == m[j] - low[j] else m[j] - move
        e -= move * (k[i] - k[j])
    return m


def local(b: Block, y: np.ndarray, m: np.ndarray, f: np.ndarray, c: float, gammas: list[float] | None, tol: float, rng: np.random.Generator | None = None) -> np.ndarray:
    """Moves of a part's multipliers: its chunks one after the other, each knowing the moves of those before it. A chunk keeps its sum, so chunks have to be drawn anew (rng, by left vector) each time."""
    moved, f = np.zeros(len(y)), f.copy()
    order = np.arange(len(y)) if rng is None else np.argsort(rng.permutation(len(b.left))[b.li], kind="stable")
    chunks = [order[s : s + CHUNK] for s in range(0, len(y), CHUNK)]
    for n, at in enumerate(chunks):
        mine = taken(b, at)
        new = descend(gram(mine, mine, gammas), y[at] - f[at], m[at], np.minimum(0, c * y[at]), np.maximum(0, c * y[at]), tol, 5 * len(at))
        moved[at] = new - m[at]
        for later in chunks[n + 1 :]:
            f[later] += effects(taken(b, later), Moves(np.zeros(len(later), int), np.zeros(len(later)), 1), mine, Moves(np.zeros(len(at), int), moved[at], 1), gammas)[0][:, 0]
    return moved


def different(vectors: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal vectors of several tables as one."""
    x = np.concatenate(vectors)
    x, at = np.unique(x, axis=0, return_inverse=True)
    start = np.cumsum([0, *(len(v) for v in vectors)])
    return x, at.reshape(-1)[np.concatenate([p + s for p, s in zip(places, start, strict=False)])]


SHAPE = "left binary, right binary, li binary, ri binary, y binary, grp binary"
BRICK = f"brick long, {SHAPE}, m binary, f binary"
PIECE = f"part int, bricks array<long>, sizes array<int>, {SHAPE}, m binary, f binary, moved binary"


def packed(r: Block, y: np.ndarray, grp: np.ndarray) -> dict[str, bytes]:
    return {"left": r.left.tobytes(), "right": r.right.tobytes(), "li": r.li.astype(np.int64).tobytes(), "ri": r.ri.astype(np.int64).tobytes(), "y": y.astype(float).tobytes(), "grp": grp.astype(np.int64).tobytes()}


def opened(r, prefix: str = "") -> tuple[Block, np.ndarray, np.ndarray]:
    get = lambda n, t=float: np.frombuffer(getattr(r, prefix + n), t)
    li, ri = get("li", np.int64), get("ri", np.int64)
    return Block(get("left").reshape(int(li.max()) + 1, -1), get("right").reshape(int(ri.max()) + 1, -1), li, ri), get("y"), get("grp", np.int64)


def moves(grp: np.ndarray, moved: np.ndarray) -> tuple[Moves, np.ndarray]:
    """Groups of one sign each, and how far each moves."""
    name, at = np.unique(2 * grp + (moved < 0), return_inverse=True)
    total = np.bincount(at, moved, len(name))
    return Moves(at, moved / np.where(total == 0, 1, total)[at], len(name)), total


def bricks_of(pairs: DataFrame, number: int) -> DataFrame:
    """(brick, ids, the block) of pairs (left_id, right_id, y, _l, _r), by left id; a brick has a PART's quarter at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        pdf = pd.concat(rows).sort_values(["left_id", "right_id", "y"])
        for n, s in enumerate(range(0, len(pdf), PART // 4)):
            part = pdf.iloc[s : s + PART // 4]
            tables = []
            for i, v in (("left_id", "_l"), ("right_id", "_r")):
                code, _ = pd.factorize(part[i])
                first = np.unique(code, return_index=True)[1]
                tables.append((np.array(part[v].iloc[first].tolist(), float), code))
            (left, li), (right, ri) = tables
            y = part["y"].to_numpy(float)
            zero = np.zeros(len(part)).tobytes()
            yield pd.DataFrame([{"brick": TaskContext.get().partitionId() * 1_000_000 + n, "left_ids": part["left_id"].tolist(), "right_ids": part["right_id"].tolist(), "ys": part["y"].tolist(), **packed(Block(left, right, li, ri), y, part["_g"].to_numpy()), "m": zero, "f": zero}])

    kinds = dict(pairs.dtypes)
    schema = f"brick long, left_ids array<{kinds['left_id']}>, right_ids array<{kinds['right_id']}>, ys array<{kinds['y']}>, " + BRICK.removeprefix("brick long, ")
    grouped = pairs.withColumn("_g", F.pmod(F.xxhash64("right_id"), F.lit(GROUPS)))
    return cut(grouped.repartition(number, "left_id").mapInPandas(run, schema))


def fit_scores(pairs: DataFrame, gammas: list[float] | None, o: svm.Options, gap: float, seed: int) -> DataFrame:
    """(left_id, right_id, y, score) of pairs (left_id, right_id, y, _l, _r), by the model fitted on all of them.

    gap: of the values of the primal and the dual problem, as a share of the primal; the rounds end there, or after
    ``o.max_iter`` of them. Vectors have no missing places.
    """
    spark, count = pairs.sparkSession, pairs.count()
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(cores, count // LEAST), -(-count // PART))
    named = bricks_of(pairs, 4 * parts if parts > 1 else 1)
    rows, path = named.drop("left_ids", "right_ids", "ys"), None
    rng, c = np.random.default_rng(seed), o.C
    keys = sorted(r["brick"] for r in rows.select("brick").collect())

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, pdf in pd.concat([b for b in batches] or [pd.DataFrame({"part": []})]).groupby("part"):
            pdf = pdf.sort_values("brick")
            each = [opened(r) for r in pdf.itertuples(index=False)]
            left, li = different([b.left for b, _, _ in each], [b.li for b, _, _ in each])
            right, ri = different([b.right for b, _, _ in each], [b.ri for b, _, _ in each])
            b, y, grp = Block(left, right, li, ri), np.concatenate([y for _, y, _ in each]), np.concatenate([g for _, _, g in each])
            m, f = (np.concatenate([np.frombuffer(v) for v in pdf[n]]) for n in ("m", "f"))
            moved = local(b, y, m, f, c, gammas, o.tol, np.random.default_rng([seed, turn, int(part)]))
            yield pd.DataFrame([{"part": part, "bricks": pdf["brick"].tolist(), "sizes": [len(y) for _, y, _ in each], **packed(b, y, grp), "m": m.tobytes(), "f": f.tobytes(), "moved": moved.tobytes()}])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                (a, ya, ga), (b, _, gb) = opened(r), opened(r, "o_")
                (ma, _), (mb, _) = moves(ga, np.frombuffer(r.moved)), moves(gb, np.frombuffer(r.o_moved))
                ab, ba = effects(a, ma, b, mb, gammas)
                out = [(r.part, r.o_part, ab.tobytes(), (ma.table().T @ ab).tobytes())]
                if r.part != r.o_part:
                    out.append((r.o_part, r.part, ba.tobytes(), (mb.table().T @ ba).tobytes()))
                yield pd.DataFrame(out, columns=["part", "by", "u", "k"])

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                mv, total = moves(np.frombuffer(r.grp, np.int64), np.frombuffer(r.moved))
                yield pd.DataFrame([{"part": r.part, "total": total.tobytes(), "slope": (mv.table().T @ (np.frombuffer(r.y) - np.frombuffer(r.f))).tobytes()}])

    def felt(share: dict):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    v = share[r.by][0]
                    yield pd.DataFrame([{"part": r.part, "by": r.by, "df": (np.frombuffer(r.u).reshape(-1, len(v)) @ v).tobytes()}])

        return run

    def gone(share: dict):
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            r = left.iloc[0]
            b, y, grp = opened(r)
            mv, _ = moves(grp, np.frombuffer(r["moved"]))
            m = np.frombuffer(r["m"]) + np.frombuffer(r["moved"]) * share[r["part"]][1][mv.group]
            m = np.clip(m, np.minimum(0, c * y), np.maximum(0, c * y))
            f = np.frombuffer(r["f"]) + sum(np.frombuffer(v) for v in right.sort_values("by")["df"])
            out, s = [], 0
            for brick, n in zip(r["bricks"], r["sizes"], strict=True):
                here = slice(s, s + n)
                out.append({"brick": brick, **packed(taken(b, np.arange(s, s + n)), y[here], grp[here]), "m": m[here].tobytes(), "f": f[here].tobytes()})
                s += n
            return pd.DataFrame(out)

        return run

    for turn in range(o.max_iter):
        dealt = F.create_map(*(F.lit(int(v)).cast(t) for k, p in zip(keys, rng.permutation(len(keys)) % parts, strict=True) for v, t in ((k, "long"), (p, "int"))))[F.col("brick")]
        pieces = cut(rows.withColumn("part", dealt).repartitionByRange(parts, "part").mapInPandas(solve, PIECE))
        shape = ["part", "left", "right", "li", "ri", "y", "grp", "moved"]
        other = pieces.select(*(F.col(x).alias(f"o_{x}") for x in shape))
        met = pieces.select(*shape).crossJoin(other.hint("shuffle_replicate_nl")).filter("part <= o_part")
        met, met_at = stored(met.mapInPandas(meet, "part int, by int, u binary, k binary"))
        facts = {r["part"]: (np.frombuffer(r["total"]), np.frombuffer(r["slope"])) for r in pieces.mapInPandas(totals, "part int, total binary, slope binary").collect()}
        size = {p: len(t) for p, (t, _) in facts.items()}
        at = dict(zip(facts, np.cumsum([0, *size.values()]), strict=False))
        total, slope = (np.concatenate([x[i] for x in facts.values()]) for i in (0, 1))
        k = np.zeros((len(total), len(total)))
        for r in met.select("part", "by", "k").collect():
            p, q = r["part"], r["by"]
            k[at[p] : at[p] + size[p], at[q] : at[q] + size[q]] = np.frombuffer(r["k"]).reshape(size[p], size[q])
        far = descend((k + k.T) / 2, slope, np.zeros(len(total)), np.minimum(0, total), np.maximum(0, total), o.tol * 1e-2, 50 * len(total) + 1000)
        share = {p: (far[at[p] : at[p] + size[p]], np.where(facts[p][0] == 0, 0, far[at[p] : at[p] + size[p]] / np.where(facts[p][0] == 0, 1, facts[p][0]))) for p in facts}

        change = met.mapInPandas(felt(share), "part int, by int, df binary")
        old = path
        rows, path = stored(pieces.groupBy("part").cogroup(change.groupBy("part")).applyInPandas(gone(share), BRICK))
        for p in (met_at, old):
            if p:
                discard(spark, p)
        b, primal, dual = values(rows, c)
        if primal - dual <= gap * primal:
            break
    scores = cut(rows.mapInPandas(lambda batches: (pd.DataFrame({"brick": p["brick"], "scores": [(np.frombuffer(v) + b).tolist() for v in p["f"]]}) for p in batches), "brick long, scores array<double>"))
    discard(spark, path)
    zipped = named.select("brick", "left_ids", "right_ids", "ys").join(scores, "brick").select(F.explode(F.arrays_zip("left_ids", "right_ids", "ys", "scores")).alias("r"))
    return zipped.select(F.col("r.left_ids").alias("left_id"), F.col("r.right_ids").alias("right_id"), F.col("r.ys").alias("y"), F.col("r.scores").alias("score"))


def values(rows: DataFrame, c: float, points: int = 65) -> tuple[float, float, float]:
    """b of least loss, and the values of the primal and the dual problem."""

    def loss(grid: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    y, m, f = (np.frombuffer(getattr(r, n)) for n in ("y", "m", "f"))
                    e = y - f
                    lost = [float(np.maximum(0, 1 - y * (f + v)).sum()) for v in grid]
                    yield pd.DataFrame([{"lost": lost, "low": e.min(), "high": e.max(), "square": float(m @ f), "line": float(y @ m)}])

        return rows.select("y", "m", "f").mapInPandas(run, "lost array<double>, low double, high double, square double, line double").collect()

    found = loss(np.zeros(0))
    square, line = sum(r["square"] for r in found), sum(r["line"] for r in found)
    low, high = min(r["low"] for r in found), max(r["high"] for r in found)
    for _ in range(4):
        grid = np.linspace(low, high, points)
        lost = np.sum([r["lost"] for r in loss(grid)], 0)
        i = int(lost.argmin())
        low, high = grid[max(0, i - 1)], grid[min(points - 1, i + 1)]
    return float(grid[i]), float(square / 2 + c * lost[i]), float(line - square / 2)
