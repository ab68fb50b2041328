"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts are word sequences. Of every six consecutive 5-word hashes the least is kept (the rightmost
of equals), so two texts that share ten words in a row keep a common fingerprint inside them. The
benchmark's 10-word windows are indexed by the one fingerprint that each keeps; a document's
fingerprints carry the words around them, and a match is extended by comparing the window's words
with those. Thus every occurrence of a window is found, and nothing else counts. Items of fewer
than ten words are one window each and are looked up by all of their words.

Neither texts nor unmatched fingerprints are shuffled while the index is below MAX_INDEX bytes and
so can be broadcast; a larger index is joined by a shuffle on the fingerprints.

Defined cases: null texts and texts without words have no window and are not contaminated; texts
of any length are whole; items without words are ignored; a row that repeats another gets the same
result; ids may be of any type, a null doc_id is kept as a document and a null item_id ignored as an
item; empty tables on either side are fine; other columns, whatever their names, are ignored by
``hits`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzloom.llm.common import cut, text_key, without_rows

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = (1 << 31) - 1
MAX_INDEX = 64 << 20
#: A bitmap of the index's fingerprints, 2^18 bits whatever the index: what it lacks is in no window.
FILTER_WORDS = 1 << 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body's lambdas read it."""
    return F.transform(F.array(value), body)[0]


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), BREAK, -1), "")


def upto(n: Column) -> Column:
    """0 .. n-1, empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def around(w: Column, at: Column) -> Column:
    """The words from WINDOW-1 before a fingerprint to SPAN-1 after its start, null beyond the ends."""
    return F.array(*(F.get(w, at + (k - WINDOW + 1)) for k in range(SPAN + WINDOW - 1)))


def bit(print_: Column) -> tuple[Column, Column]:
    """Where the filter has a fingerprint: the number of a 64-bit word, and the bit."""
    return F.shiftrightunsigned(print_, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), print_.bitwiseAND(F.lit(63)).cast("int"))


def prints(w: Column, lengths: tuple[int, ...], seen: Column | None = None) -> Column:
    """array<struct<at, print, near>>: the winnowed fingerprints of a word array, and every gram of the given lengths below SPAN.

    seen: the filter's words; fingerprints whose bit is not set there are left out before their words are gathered.
    """

    def elements(pairs: Column) -> Column:
        if seen is not None:
            pairs = F.filter(pairs, lambda p: F.get(seen, bit(p["print"])[0]).bitwiseAND(bit(p["print"])[1]) != 0)
        return F.transform(pairs, lambda p: F.struct(p["at"].alias("at"), p["print"].alias("print"), around(w, p["at"]).alias("near")))

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        pair = lambda at, print_: F.struct(at.alias("at"), print_.alias("print"))
        gram = lambda i, m: F.xxhash64(*(F.get(h, i + k) for k in range(m)))

        def of_grams(g: Column) -> Column:
            # the order of grams: high bits of the hash, then the later place
            ranks = F.transform(g, lambda x, i: x.bitwiseAND(F.lit(~LAST)).bitwiseOR((F.lit(LAST) - i).cast("long")))
            least = lambda v: F.transform(upto(n - (SPAN - 1)), lambda i: F.least(*(F.get(v, i + k) for k in range(WINDOW))))
            place = lambda v: (F.lit(LAST) - v.bitwiseAND(F.lit(LAST))).cast("int")
            return F.transform(F.array_distinct(let(ranks, least)), lambda v: pair(place(v), F.get(g, place(v))))

        found = F.when(n >= SPAN, let(F.transform(upto(n - (GRAM - 1)), lambda i: gram(i, GRAM)), of_grams))
        whole = lambda m: F.transform(upto(n - (m - 1)), lambda i: pair(i, gram(i, m)))
        return F.concat(F.coalesce(found, F.array().cast("array<struct<at:int,print:bigint>>")), *map(whole, lengths))

    return elements(let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes))


def index(benchmark: DataFrame) -> tuple[DataFrame, tuple[int, ...], int]:
    """Windows (print, shift, window, items), the lengths of windows below SPAN, and the bytes of the table."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words().alias("w")).filter("item is not null and size(w) > 0")
    cuts = F.when(F.size("w") < SPAN, F.array("w")).otherwise(F.transform(upto(F.size("w") - (SPAN - 1)), lambda i: F.slice("w", i + 1, SPAN)))
    windows = items.select("item", F.explode(cuts).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))
    windows = windows.withColumn("p", F.get(prints(F.col("window"), ()), F.lit(0)))
    short = F.expr("case size(window) " + " ".join(f"when {m} then xxhash64({', '.join(f'xxhash64(window[{k}])' for k in range(m))})" for m in range(1, SPAN)) + " end")
    table = cut(windows.select(F.coalesce(short, F.col("p.print")).alias("print"), F.coalesce("p.at", F.lit(0)).alias("shift"), "window", "items"))
    lengths = tuple(sorted(r[0] for r in table.filter(F.size("window") < SPAN).select(F.size("window")).distinct().collect()))  # nine numbers at most
    size = table.agg(F.sum(F.octet_length(F.array_join("window", "  ")) * 2 + F.octet_length(F.array_join("items", "  ")) * 2 + 200)).first()[0]
    return table, lengths, int(size or 0)


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tk, n_words, n_hit, items): a row for each row; items are the ids of items with a window in it, as sorted strings."""
    table, lengths, size = index(benchmark)
    at, mask = bit(F.col("print"))
    filled = dict(table.groupBy(at.alias("i")).agg(F.bit_or(mask)).collect())  # FILTER_WORDS rows at most
    seen = F.from_json(F.lit(str([filled.get(i, 0) for i in range(FILTER_WORDS)])), "array<long>")  # folded to one literal
    if size <= MAX_INDEX:
        table = F.broadcast(table)
    mark = lambda n: F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("print"), F.array().cast("array<string>").alias("near"), n.alias("n")))
    found = lambda w: F.transform(prints(w, lengths, seen), lambda p: F.struct(p["at"].alias("at"), p["print"].alias("print"), p["near"].alias("near"), F.lit(0).alias("n")))
    rows = docs.select("doc_id", text_key().alias("tk"), F.explode(let(words(), lambda w: F.concat(mark(F.size(w)), found(w)))).alias("p")).select("doc_id", "tk", "p.*")
    rows = rows.join(table, "print", "left")
    same = F.slice("near", WINDOW - F.col("shift"), F.size("window")) == F.col("window")
    rows = rows.filter((F.col("at") < 0) | same)
    start = F.col("at") - F.col("shift")
    out = rows.groupBy("doc_id", "tk").agg(
        F.max("n").alias("n"), F.sum(F.when(F.col("at") < 0, 1)).alias("copies"),
        F.collect_set(F.when(F.col("at") >= 0, F.struct(start.alias("a"), (start + F.size("window")).alias("b")))).alias("spans"),
        F.collect_set("items").alias("items"),
    )
    covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")), lambda acc: acc["n"])
    out = out.select("doc_id", "tk", F.col("n").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_"))
    return out.drop("_")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns. Texts are not shuffled while the contaminated rows can be broadcast."""
    return without_rows(docs, cut(hits(docs, benchmark).filter("n_hit > 0").select("doc_id", "tk").distinct()))


def op5_decontam(spark, sf_dir: str) -> DataFrame:
    out = hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
x AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (
  SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM x))),
h AS (SELECT r, g.n, i, item_id FROM g JOIN x ON g.g = x.g AND g.n = x.n),
c AS (SELECT r, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN t ON d.r = t.r
"""
