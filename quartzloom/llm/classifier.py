"""Quality classifier: random-indexing word vectors pooled by document, and a two-layer network.

Each word falls into one of BUCKETS buckets by a hash of its bytes; each bucket has a fixed random index vector
with a few entries of 1 and -1. A word's vector is the sum of the index vectors of the words at most
WINDOW places from each of its occurrences, in all documents, brought to length 1. It is a table of
fixed size (BUCKETS x DIMS, 4 MB as int16), whatever the corpus, so it is read to the driver and sent to
all tasks. A document is pooled to the mean of its words' vectors and the mean of the products of
neighbours' vectors. A network of one hidden layer is fitted by numpy in one worker on SAMPLE labelled
documents at most, of those not held out; a quarter of them, not fitted on, sets the temperature that
its logits are divided by, so that scores are probabilities. Sums are of integers and so do not depend on how rows are dealt.

A word is a run of letters (A-Z lower-cased; every character beyond ASCII counts as a letter) or of digits; any
other character but white space is a word of its own, and so is a line feed.

Defined cases: a null or empty text, or one of white space, pools to zeros and has a score like any other; texts of
any length are read whole, a part at a time; a null doc_id is hashed as ''; repeated rows of documents are scored each; of several labels
of a document the least counts, null labels do not; with no label, or labels of one class, every score is that class's
share of the labels with one more of each class; an empty table gives no rows; other columns, whatever their names,
are ignored. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.llm.common import by_rows, cut, id_ddl, map_arrow
from quartzloom.models.train import in_worker

BUCKETS, DIMS, NONZERO, WINDOW = 1 << 16, 32, 4, 2
#: Labelled documents that the network is fitted and calibrated on, at most.
SAMPLE = 8_000
THRESHOLD = 0.3
#: Bytes hashed at a time, and words whose contexts, or vectors, are summed at a time.
STEP, HELD, POOLED = 1 << 20, 1 << 20, 1 << 16
#: An entry of a vector is an integer of this scale.
UNIT = 32767

#: By byte: 0 white space, 1 letter, 2 digit, 3 a word of its own.
KIND = np.array([0 if c in b" \t\r\v\f" else 1 if c > 127 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)
CODE = np.array([0 if KIND[c] == 0 else c + 33 if 65 <= c <= 90 else c + 1 for c in range(256)], np.uint64)
BASE, MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of all texts in turn, and the number of its text. A word's hash is a polynomial in its bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + STEP)
        if end < len(data):  # a part ends where a word does
            apart = lambda k, b: (k != b) | (k == 3)
            near = np.flatnonzero(apart(KIND[data[at + 1 : end + 1]], KIND[data[at:end]]))
            while not len(near) and end < len(data):
                at_most = min(len(data), end + STEP)
                far = np.flatnonzero(apart(KIND[data[end + 1 : at_most]], KIND[data[end : at_most - 1]]))
                near, end = (far[:1] + end - at, at_most) if len(far) else (near, at_most)
            end = at + int(near[-1]) + 1 if len(near) else len(data)
        part, kind = data[at:end], KIND[data[at:end]]
        new = (kind != 0) & ((kind == 3) | first[at:end] | np.r_[True, kind[1:] != kind[:-1]])
        starts = np.flatnonzero(new)
        if len(starts):
            part, new = part[starts[0] :], new[starts[0] :]
            place = np.arange(len(part)) - (starts - starts[0])[np.cumsum(new) - 1]
            power = np.cumprod(np.r_[np.uint64(1), np.full(int(place.max()), BASE)], dtype=np.uint64)
            code = np.add.reduceat(CODE[part] * power[place], starts - starts[0], dtype=np.uint64)
            code = (code ^ (code >> np.uint64(32))) * MIX
            found.append(((code >> np.uint64(48)).astype(np.int32), starts + at))
        at = end
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    buckets, places = (np.concatenate(x) for x in zip(*found, strict=True))
    return buckets, np.searchsorted(offsets, places, side="right") - 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of each bucket's index vector; an entry may fall on a place twice."""
    r = np.random.default_rng(11)
    return r.integers(0, DIMS, (BUCKETS, NONZERO)), r.choice([-1, 1], (BUCKETS, NONZERO))


def add_contexts(sums: np.ndarray, buckets: np.ndarray, texts: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    for off in range(1, WINDOW + 1):
        same = texts[off:] == texts[:-off]
        a, b = buckets[:-off][same].astype(np.int64), buckets[off:][same].astype(np.int64)
        for left, right in ((a, b), (b, a)):
            for j in range(NONZERO):
                sums += np.bincount(left * DIMS + places[right, j], weights=signs[right, j], minlength=BUCKETS * DIMS).astype(np.int64)


def whole_texts(docs: DataFrame, *others) -> DataFrame:
    return docs.select(*others, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def context_sums(docs: DataFrame) -> DataFrame:
    """(bucket, d0 ...): sums of index vectors over all occurrences; a row a bucket, for buckets that have any."""
    names = [f"d{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (places, signs), sums, held, seen = index_vectors(), np.zeros(BUCKETS * DIMS, np.int64), [], 0
        for batch in batches:
            for part in by_rows([batch]):
                buckets, texts = words(part.column(0))
                held.append((buckets, texts + seen))
                seen += part.num_rows
                if sum(len(b) for b, _ in held) > HELD:
                    add_contexts(sums, *map(np.concatenate, zip(*held, strict=True)), places, signs)
                    held = []
        if held:
            add_contexts(sums, *map(np.concatenate, zip(*held, strict=True)), places, signs)
        table = sums.reshape(BUCKETS, DIMS)
        has = np.flatnonzero(table.any(axis=1))
        for i in range(0, len(has), 8192):
            some = has[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(np.ascontiguousarray(table[some, d])) for d in range(DIMS))], names=["bucket", *names])

    parts = map_arrow(whole_texts(docs), run, ", ".join(["bucket int", *(f"{n} long" for n in names)]))
    return parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all buckets, of length 1 in units of 1/UNIT; zeros where a bucket has no neighbour. At most BUCKETS rows are read."""
    table, out = context_sums(docs).toArrow(), np.zeros((BUCKETS, DIMS))
    out[table["bucket"].to_numpy()] = np.column_stack([table[f"d{i}"].to_numpy() for i in range(DIMS)]).astype(float)
    return np.rint(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9) * UNIT).astype(np.int16)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean of its words' vectors, and that of the products of neighbours' vectors."""
    buckets, of = words(texts)
    sums, counts = np.zeros((len(texts), 2 * DIMS), np.int64), np.bincount(of, minlength=len(texts))
    for i in range(0, len(buckets), POOLED):
        v, t = vectors[buckets[i : i + POOLED + 1]].astype(np.int32), of[i : i + POOLED + 1]
        near = v[:-1] * v[1:] * (t[:-1] == t[1:])[:, None]  # the last pair reaches into the next part
        for rows, owner, at in ((v[:POOLED], t[:POOLED], 0), (near, t[:-1], DIMS)):
            if len(rows):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sums[owner[starts], at : at + DIMS] += np.add.reduceat(rows, starts, axis=0, dtype=np.int64)
    means = sums / np.maximum(np.column_stack([np.repeat(counts[:, None], DIMS, 1), np.repeat(counts[:, None] - 1, DIMS, 1)]), 1)
    return np.column_stack([means[:, :DIMS] / UNIT, means[:, DIMS:] / UNIT**2]).astype(np.float32)


def pool(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, pooled)."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_rows(batches):
            x = pooled(part.column(1), sent.value)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 2 * DIMS, np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), rows], names=["doc_id", "pooled"])

    return map_arrow(whole_texts(docs, "doc_id"), run, f"{id_ddl(docs)}, pooled array<float>")


@dataclass
class Network:
    """mean, std scale the inputs; prior is the score where nothing could be fitted."""

    prior: float
    mean: np.ndarray | None = None
    std: np.ndarray | None = None
    layers: tuple = ()
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh(np.clip((x - self.mean) / self.std, -10, 10) @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40))) if self.layers else np.full(len(x), self.prior)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What logits are divided by for the least log loss, between 1/20 and 20. Smoothed labels keep it from a limit where all are right."""
    if not len(y):
        return 1.0
    soft = (y * len(y) + 0.5) / (len(y) + 1)
    tries = np.exp(np.linspace(-np.log(20), np.log(20), 241))
    loss = [np.mean(np.logaddexp(0, logits / t) - soft * logits / t) for t in tries]
    return float(tries[int(np.argmin(loss))])


def fit(x: np.ndarray, y: np.ndarray, fitted: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.003, decay: float = 1e-4) -> Network:
    """Fit on the marked rows by Adam on batches of 128, and set the temperature by the others."""
    out = Network((float(y.sum()) + 1) / (len(y) + 2))
    x1, y1 = x[fitted].astype(float), y[fitted].astype(float)[:, None]
    if len(set(y1.ravel())) < 2:
        return out
    out.mean, out.std = x1.mean(axis=0), x1.std(axis=0) + 1e-6
    z, r, n = np.clip((x1 - out.mean) / out.std, -10, 10), np.random.default_rng(7), x.shape[1]
    p = [r.normal(0, n**-0.5, (n, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = r.permutation(len(z))
        for s in range(0, len(z), 128):
            i = order[s : s + 128]
            h = np.tanh(z[i] @ p[0] + p[1])
            off = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y1[i]) / len(i)
            back = off @ p[2].T * (1 - h * h)
            step += 1
            for k, g in enumerate((z[i].T @ back + decay * p[0], back.sum(axis=0), h.T @ off + decay * p[2], off.sum(axis=0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    out.layers = tuple(p)
    out.temperature = temperature(out.logits(x[~fitted].astype(float)), y[~fitted].astype(float))
    return out


def fold_of(ident: str = "doc_id"):
    """crc32 of the id as text, mod 5; 0 is held out, 1 sets the temperature."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit(""))) % 5


def train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network for pooled rows (doc_id, pooled): from those that have a label and are not held out, all or ``sample`` of them by draw."""
    marks = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("_of")).agg((F.min("quality") > 0).cast("int").alias("y"))
    known = rows.filter(fold_of() != 0).join(marks, F.col("doc_id") == F.col("_of"))
    known = known.select("pooled", "y", (fold_of() != 1).alias("fitted"), F.xxhash64("doc_id", "pooled").alias("_draw"))
    n = known.count()
    if n > sample:  # the rows below a bound are about a fifth more than wanted, so that no task sorts them all
        known = known.filter(F.pmod("_draw", F.lit(1 << 32)) < int(1.2 * sample / n * (1 << 32)))
    known = known.orderBy(F.pmod("_draw", F.lit(1 << 32)), "_draw").limit(sample)

    def run(pdf: pd.DataFrame) -> Network:
        pdf = pdf.sort_values(["_draw", "y"])
        return fit(np.array(pdf["pooled"].tolist(), np.float32), pdf["y"].to_numpy(), pdf["fitted"].to_numpy(bool))

    return in_worker(known, run) or Network(0.5)


def score(rows: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of pooled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(b.num_rows, 2 * DIMS)
            s = network.scores(x.astype(float))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(rows.select("doc_id", (fold_of() == 0).alias("held_out"), "pooled"), run, f"{id_ddl(rows)}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Two readings of the texts: one for the word vectors, one to pool. Training and scores read the pooled rows."""
    rows = cut(pool(docs, word_vectors(docs)))
    return score(rows, train(rows, labels, sample))


def op11_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
