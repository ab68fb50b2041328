"""Packing of token pieces into sequences, by the configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. A
configuration is a multiset of lengths that fit one sequence. The program - cover all demands
with the fewest configurations - is begun by multiplicative weights: each step prices the
lengths by their unmet demand, finds the most valuable configurations by knapsack dynamic
programming, takes amounts of them, and lowers the weights of what they cover. Their sum is 1 to 3
per cent above the optimum where configurations must fit closely, so the program is then finished
by exact steps: the weights' configurations are the first columns of a simplex, whose duals are
priced by the same knapsack. A dual over its best knapsack is a bound on any packing, by which the
steps end. The solution is rounded down, all of it or its fullest sequences, and what is left of
the histogram is packed best-fit by length, largest first, into the gaps and new sequences. Of more
than CLASSES lengths, the program is over classes of lengths, rounded up; some short pieces are
then held back for the gaps that this leaves.

Pieces get their places without a window over all pieces of a length: each task numbers its own
pieces by length, and counts by (task, length) give the offsets. The numbered pieces are written
once, so the numbers hold whatever executors are lost later; ``common.release`` removes them.

Defined cases: null texts are empty ones, whose only id is 1; repeated rows are packed each for
itself; ids may be null and of any type; texts of over ``capacity`` ids, of any length, are cut
into full pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzloom.llm.common import by_rows, id_ddl, map_arrow, new_path, record, store

FILE, END, CAPACITY = "word_bpe_49k.json", 1, 4096
PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])
PIECES_DDL = "piece int, start long, length long, ids_crc32 long, task int, rank long"
#: Words kept with their ids in a worker, about 60 MB.
WORDS_KEPT = 250_000
#: Of equally full configurations, those of larger pieces are worth more: prices grow as length to this power more.
LARGER = 0.05


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = byte_letters()


class Words(dict):
    """Ids of words, as little-endian bytes. Pre-tokens are encoded independently, so a text's ids are those of its words in a row; the merges are the library's."""

    def __init__(self, model):
        self.merge = model.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        ids = array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(BYTES))])
        if sys.byteorder == "big":
            ids.byteswap()
        ids = ids.tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids


def letters(kind: str) -> str:
    return "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: Texts of these characters only need no Unicode composition, become lower-case one by one within the range, and split alike in Python and in the tokenizer.
PLAIN = re.compile("[\t-\r\x20-\x7e" + "".join(chr(c) for c in range(0xA0, 0x250) if len(low := chr(c).lower()) == 1 and ord(low) < 0x250) + "]*")
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters('L')}]+|[{letters('N')}]|[^\\s{letters('L')}{letters('N')}]+")


#: What a file's normaliser and pre-tokenizer must be for the words of SPLIT to be its pre-tokens.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def by_words(path: str) -> bool:
    """Whether a file's ids are those of its words in a row, and its added tokens all begin with <|."""
    rules = json.loads(Path(path).read_text())
    return rules["normalizer"] == NORMALISER and rules["pre_tokenizer"] == PRE_TOKENIZER and rules.get("post_processor") is None and all(t["content"].startswith("<|") for t in rules["added_tokens"])


@lru_cache
def encoder(path: str) -> Callable[[str], bytes]:
    """A text's ids as little-endian unsigned 32-bit numbers. By words where the file's rules allow it, else by the library: tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        import sentencepiece

        pieces_of = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: np.array(pieces_of.encode(text, num_threads=1), "<u4").tobytes()
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    whole = lambda text: np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if not by_words(path):
        return whole
    words = Words(model)

    def encode(text: str) -> bytes:
        if "<|" not in text and PLAIN.fullmatch(text):
            return b"".join([words[w] for w in SPLIT.findall(text.lower())])
        return whole(text)

    return encode


def pieces(docs: DataFrame, file: str = FILE, capacity: int = CAPACITY) -> DataFrame:
    """Numbered pieces: rank counts from 0 among the pieces of a length in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = encoder(public_tokenizers.path(file)), Counter(), TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()
        for part in by_rows(batches):
            rows, places = [], []
            for nth, text in enumerate(part.column(1).to_pylist()):
                ids = encode(text or "") + end
                for i in range(0, len(ids), 4 * capacity):
                    piece = ids[i : i + 4 * capacity]
                    n = len(piece) // 4
                    places.append(nth)
                    rows.append((i // (4 * capacity), i // 4, n, zlib.crc32(piece), task, seen[n]))
                    seen[n] += 1
            rest = record(PIECES, *(zip(*rows, strict=True) if rows else [[]] * len(PIECES)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(places, pa.int32())), *rest.columns], names=["doc_id", *PIECES.names])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"{id_ddl(docs)}, {PIECES_DDL}")


def price(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack dynamic programming over sizes (ascending): the best value of each capacity, and the size that it took last (-1: none)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            gain = value[:k] + best[c - sizes[:k]]
            j = int(gain.argmax())
            if gain[j] > best[c]:
                best[c], took[c] = gain[j], j
    return best, took


def trace(took: np.ndarray, sizes: np.ndarray, capacity: int) -> Counter:
    """The multiset of a capacity's best value: {index: copies}."""
    out: Counter = Counter()
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[int(took[c])] += 1
            c -= int(sizes[took[c]])
    return out


def weighted(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 60, rate: float = 1.0, near: float = 0.97, batch: int = 32) -> list[dict[int, int]]:
    """Configurations found by multiplicative weights.

    Each step prices the lengths that are not yet covered, and takes configurations whose value is within ``near`` of the
    best, each the best one with a given length in it, up to ``batch``. Amounts stay within what is not yet covered; a
    length's weight falls with its covered share. Ends when a step finds no configuration, or the steps are used.
    """
    covered, out = np.zeros(len(sizes)), []
    for _ in range(steps):
        value = np.where(demand - covered >= 1, sizes * (sizes / capacity) ** LARGER * np.exp(-rate * covered / demand), 0.0)
        best, took = price(value, sizes, capacity)
        total = np.where(value > 0, value + best[capacity - sizes], 0)
        found = len(out)
        for i in np.argsort(-total, kind="stable")[: 4 * batch].tolist():
            if total[i] <= 0 or total[i] < near * best[capacity] or len(out) - found >= batch:
                break
            config = trace(took, sizes, capacity - int(sizes[i]))
            config[i] += 1
            amount = min((demand[j] - covered[j]) / k for j, k in config.items())
            if amount >= 1:
                amount = max(1.0, amount / 2)
                for j, k in config.items():
                    covered[j] += amount * k
                out.append(dict(config))
        if len(out) == found:
            break
    return out


def finished(sizes: np.ndarray, demand: np.ndarray, capacity: int, configs: list[dict[int, int]], gap: float = 1e-3, limit: int = 6_000, stall: int = 400) -> tuple[list[tuple[dict[int, int], float]], np.ndarray]:
    """Amounts of configurations that cover all demands, and duals of the lengths: a revised simplex with columns priced among the given ones first, then by knapsack.

    Ends when the amounts are within ``gap`` of the bound that the duals give, at the optimum, or at the limit of steps,
    or of steps that gain nothing; memory is the square of the number of lengths. Demands are larger by a seeded
    millionth or so while it works, as equal ratios would let it turn in circles. No threaded algebra is used: its pool
    can hang in a driver that has started a JVM.
    """
    n, true = len(sizes), demand
    demand = demand * (1 + 2e-6 * np.random.default_rng(7).random(n))
    last, since = np.inf, 0
    basis = [{i: int(capacity // sizes[i])} for i in range(n)]
    inverse = np.diag([1.0 / basis[i][i] for i in range(n)])
    amounts = demand * np.diag(inverse)
    duals = np.diag(inverse).copy()
    pool = np.zeros((len(configs), n))
    for r, config in enumerate(configs):
        pool[r, list(config)] = list(config.values())
    floor = (demand * sizes).sum() / capacity
    for _ in range(limit):
        total = float(amounts.sum())
        last, since = (total, 0) if total < last * (1 - 1e-6) else (last, since + 1)
        if since > stall:
            break
        values = np.einsum("ij,j->i", pool, duals)
        if values.max(initial=0) > 1 + 1e-6:
            config = configs[int(values.argmax())]
        else:
            positive = np.maximum(duals, 0)
            best, took = price(positive, sizes, capacity)
            floor = max(floor, (demand * positive).sum() / max(best[capacity], 1e-300))
            if best[capacity] <= 1 + 1e-7 or total <= floor * (1 + gap):
                break
            config = dict(trace(took, sizes, capacity))
        at, count = np.array(list(config)), np.array(list(config.values()), float)
        moved = inverse[:, at] @ count
        ratio = np.where(moved > 1e-9, amounts / np.where(moved > 1e-9, moved, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        share = ratio[out]
        amounts = np.maximum(amounts - share * moved, 0)
        amounts[out] = share
        row = inverse[out] / moved[out]
        duals = duals + (1 - duals[at] @ count) * row
        inverse -= np.outer(moved, row)
        inverse[out] = row
        basis[out] = config
    amounts = np.maximum(np.einsum("ij,j->i", inverse, true), 0)
    return [(c, float(x)) for c, x in zip(basis, amounts, strict=True) if x > 1e-9], np.maximum(duals, 0)


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int, begun: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over counts, into begun bins first: bins with equal content are kept as one group."""
    groups: dict[int, list[list]] = {}  # by free space: [content, number of bins]
    open_ = np.zeros(capacity + 1, bool)

    def add(free: int, content: tuple, n: int) -> None:
        groups.setdefault(free, []).append([content, n])
        open_[free] = True

    for config, n in begun:
        add(capacity - sum(int(sizes[i]) * k for i, k in config.items()), tuple(i for i, k in config.items() for _ in range(k)), n)
    for i in range(len(sizes) - 1, -1, -1):
        size, n = int(sizes[i]), int(left[i])
        while n:
            free = size + int(open_[size:].argmax())
            if open_[free]:
                content, have = groups[free].pop()
                open_[free] = bool(groups[free])
                used = min(n, have)
                if have > used:
                    add(free, content, have - used)
                add(free - size, (*content, i), used)
                n -= used
            else:
                each = capacity // size
                if n >= each:
                    add(capacity - each * size, (i,) * each, n // each)
                    n %= each
                else:
                    add(capacity - n * size, (i,) * n, 1)
                    n = 0
    return [(dict(Counter(content)), n) for same in groups.values() for content, n in same]


@dataclass
class Solution:
    """Configurations {length: copies} with how many sequences use each; together they hold exactly the histogram."""

    plan: list[tuple[dict[int, int], int]]
    #: The program's value, a bound below any packing, the sequences used, and the share of volume that the program placed.
    fractional: float = 0.0
    bound: float = 0.0
    sequences: int = 0
    placed: float = 0.0

    @property
    def gap(self) -> float:
        """Of the sequences over the bound, as a share of it."""
        return self.sequences / self.bound - 1 if self.bound else 0.0


#: Lengths, or classes of lengths, in the program at most.
CLASSES = 512
#: Shares of the program's sequences that are kept when it is rounded, the fullest first; what needs fewest sequences in the end counts.
ROUNDINGS = (1.0, 0.8, 0.6, 0.4, 0.2)


def classes_of(sizes: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Each length's class, by its largest length: all by themselves where they are few, else as narrow as the root of their number asks, which wastes least."""
    if len(sizes) <= CLASSES:
        return sizes
    share = np.cumsum(np.sqrt(demand * np.diff(sizes, prepend=sizes[0] - 1)))
    nth = np.minimum((share / share[-1] * (CLASSES - 1)).astype(np.int64), CLASSES - 1)
    last = np.r_[np.flatnonzero(np.diff(nth)), len(sizes) - 1]
    return sizes[last][np.searchsorted(last, np.arange(len(sizes)))]


def drawn(config: dict[int, int], n: int, stock: dict[int, list[list[int]]]) -> Iterator[tuple[dict[int, int], int]]:
    """n uses of a configuration of classes as configurations of lengths: stock holds each class's [length, pieces left], last first."""
    while n:
        many, content = n, Counter()
        for c, k in config.items():
            size, have = stock[c][-1]
            if have >= k:
                content[size] += k
                many = min(many, have // k)
            else:  # one sequence takes the rest of this length and some of the next
                many, need, at = 1, k, len(stock[c]) - 1
                while need:
                    used = min(need, stock[c][at][1])
                    content[stock[c][at][0]] += used
                    need, at = need - used, at - 1
        for c, k in config.items():
            need = k * many
            while need:
                used = min(need, stock[c][-1][1])
                stock[c][-1][1] -= used
                need -= used
                if not stock[c][-1][1]:
                    stock[c].pop()
        n -= many
        yield dict(content), many


def rounded(sizes: np.ndarray, plan: list[tuple[dict[int, int], int]], left: np.ndarray, share: float) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """The fullest sequences of a plan, that share of them, and what is then left. Length by length best-fit can fill better what the program leaves loose."""
    fullest = sorted(plan, key=lambda c: -sum(int(sizes[i]) * k for i, k in c[0].items()))
    room, kept, rest = int(np.ceil(share * sum(n for _, n in plan))), [], left.copy()
    for config, n in fullest:
        used = min(n, room)
        room -= used
        if used:
            kept.append((config, used))
        for i, k in config.items():
            rest[i] += (n - used) * k
    return kept, rest


def solve(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = 60, gap: float = 1e-3) -> Solution:
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return Solution([])
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    volume = int((sizes * demand).sum())
    kind = classes_of(sizes, demand)
    # held back for the gaps: shortest pieces, of twice what rounding up wastes, none longer than an eighth
    waste, held = 2.0 * float(((kind - sizes) * demand).sum()), np.zeros(len(sizes), np.int64)
    for i in range(len(sizes)):
        if waste <= 0 or sizes[i] > capacity // 8:
            break
        held[i] = min(int(demand[i]), int(-(-waste // int(sizes[i]))))
        waste -= float(held[i] * sizes[i])
    given = demand - held
    classes = np.unique(kind[given > 0])
    plan: list[tuple[dict[int, int], int]] = []
    fraction, bound, left = 0.0, volume / capacity, demand.copy()
    if len(classes):
        wanted = np.array([given[kind == c].sum() for c in classes], float)
        amounts, duals = finished(classes, wanted, capacity, weighted(classes, wanted, capacity, steps), gap)
        fraction = sum(x for _, x in amounts)
        # duals of classes as prices of lengths, over the best knapsack of lengths: a bound for the lengths themselves
        prices = np.interp(sizes, classes, duals)
        best, _ = price(prices, sizes, capacity)
        bound = max(bound, float((demand * prices).sum() / best[capacity])) if best[capacity] > 0 else bound
        stock: dict[int, list[list[int]]] = {}
        for s, k, n in zip(sizes.tolist(), kind.tolist(), given.tolist(), strict=True):
            if n:
                stock.setdefault(k, []).append([s, n])
        rest = wanted.astype(np.int64)
        place = {int(s): i for i, s in enumerate(sizes)}
        for config, x in sorted(amounts, key=lambda a: -a[1]):
            n = min(int(x + 1e-6), *(int(rest[i]) // k for i, k in config.items()))
            for i, k in config.items():
                rest[i] -= n * k
            for content, many in drawn({int(classes[i]): k for i, k in config.items()}, n, stock):
                plan.append(({place[s]: k for s, k in content.items()}, many))
                for s, k in content.items():
                    left[place[s]] -= k * many
    chosen = None
    for share in ROUNDINGS if plan else (0.0,):
        kept, rest = rounded(sizes, plan, left, share)
        whole = best_fit(sizes, rest, capacity, kept)
        count = sum(n for _, n in whole)
        if chosen is None or count < chosen.sequences:
            named = [({int(sizes[i]): k for i, k in config.items()}, n) for config, n in whole]
            chosen = Solution(named, fraction, bound, count, 1 - float((rest * sizes).sum()) / volume)
    return chosen


def places(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies a sequence, first sequence, offset there), by length and rank."""
    rows, used, sequence = [], Counter(), 0
    for config, n in plan:
        at = 0
        for size, k in sorted(config.items(), reverse=True):
            rows.append((size, used[size], k, sequence, at))
            used[size] += n * k
            at += size * k
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, file: str = FILE, capacity: int = CAPACITY, report: Callable[[Solution], None] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece. report is called with the solution: the program's value, bound and gap."""
    spark = docs.sparkSession
    rows = store(pieces(docs, file, capacity), new_path(spark, "pieces"))
    counts = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    solution = solve(histogram, capacity)
    if report:
        report(solution)
    table = places(solution.plan)
    big = np.int64(1) << 48
    first = table[:, 0] * big + table[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            size, rank = part.column(3).to_numpy(), part.column(5).to_numpy()
            at = table[np.searchsorted(first, size * big + rank, "right") - 1]
            nth = rank - at[:, 1]
            new = [pa.array(x, pa.int64()) for x in (at[:, 3] + nth // at[:, 2], at[:, 4] + nth % at[:, 2] * size)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), *new], names=[*names, "sequence_id", "offset"])

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = rows.join(before.select("task", "length", F.coalesce("before", F.lit(0)).alias("before")), ["task", "length"])
    numbered = numbered.select(*names, (F.col("rank") + F.col("before")).alias("rank"))
    return map_arrow(numbered, run, f"{id_ddl(docs)}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
