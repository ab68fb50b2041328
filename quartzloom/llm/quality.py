"""Quality rules: a ledger of failure bits and measurements, to which versioned policies apply.

Each rule is evaluated once on the whole text. The ledger keeps the measurements and one bit a
rule; a policy is a mask over those bits, so that new policies and ablations read the ledger and
never a text again. ``write_ledger`` keeps the ledger as a Parquet table of ids, text digests and
entries; ``keep_by`` takes the documents that a policy keeps from it, whatever policy was asked
before, without judging again.

Defined cases: a null text has no words; an empty text has none either; texts of any length are
measured whole; repeated rows give repeated ledger rows; an empty table gives an empty ledger; ids
may be null and of any type; other columns, whatever their names, are ignored by ``evaluate`` and
kept by ``keep_by`` and ``keep_good``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.llm.common import SPACE, by_rows, id_ddl, map_arrow, new_path, store, text_key, without_rows

WORD = re.compile(r"[^\x20\x09-\x0d]+")
#: Whole words of ASCII characters without a letter.
BARE = re.compile(r"(?<![^\x20\x09-\x0d])[\x00-\x08\x0e-\x1f!-@\[-`{-\x7f]+(?![^\x20\x09-\x0d])")
#: First characters of a bullet line, and ends of a line that breaks off.
BULLETS, ELLIPSES = "-*•‣●", ("...", "…")
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Bit i is RULES[i]. A rule reads the measurements only.
RULES = {
    "few_words": lambda m: m["n_words"] < 20,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 100 * m["n_symbols"] > 30 * m["n_words"],
    "repeated_lines": lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"],
    "shouting": lambda m: 100 * m["n_upper_words"] > 60 * m["n_words"],
    "word_length": lambda m: m["word_chars"] > 60 * m["n_words"],
    "few_letters": lambda m: 100 * m["n_letter_words"] < 70 * m["n_words"],
    "bullets": lambda m: 100 * m["n_bullet_lines"] > 90 * m["n_lines"],
    "ellipses": lambda m: 100 * m["n_ellipsis_lines"] > 30 * m["n_lines"],
    "top_pair": lambda m: 200 * m["n_top_pair"] > 20 * m["n_words"],
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy(1, ("few_words", "repeated_windows"))
PRODUCTION = Policy(3, tuple(RULES))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines", "n_top_pair", "fail_bits")


def repetition(words: list[str], size: int = WINDOW) -> tuple[int, int]:
    """Words inside windows of eight that occur twice or more, and how often the most frequent pair of words occurs. Exact: codes of pairs, fours and eights by doubling."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0, int(len(words) > 1)
    code = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    span, kinds, top = 1, len(number), 0
    while span < size and len(code) > span:
        values, code, counts = np.unique(code[:-span] * kinds + code[span:], return_inverse=True, return_counts=True)
        top = top or int(counts.max())
        span, kinds = 2 * span, len(values)
        if kinds == len(code):
            return 0, top
    if span < size:
        return 0, top
    again = np.flatnonzero(np.bincount(code)[code] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    return int((np.cumsum(edge) > 0).sum()), top


def measure(text: str | None) -> dict[str, int]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated, top = repetition(words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated, "n_lines": len(lines), "n_upper_words": sum(map(str.isupper, words)),
        "n_letter_words": len(words) - len(BARE.findall(text)), "n_bullet_lines": sum(x.lstrip(SPACE)[0] in BULLETS for x in lines),
        "n_ellipsis_lines": sum(x.rstrip(SPACE).endswith(ELLIPSES) for x in lines), "n_top_pair": top,
    }


def fail_bits(m: dict[str, int]) -> int:
    return sum(BIT[name] for name, rule in RULES.items() if rule(m))


def entries(texts: pa.Array) -> pa.StructArray:
    rows = [m | {"fail_bits": fail_bits(m)} for m in map(measure, texts.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in MEASURES], MEASURES)


def evaluate(docs: DataFrame) -> DataFrame:
    """The ledger: doc_id, measurements and fail_bits, a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_rows(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *entries(part.column(1)).flatten()], names=["doc_id", *MEASURES])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, ", ".join([id_ddl(docs), *(f"{k} long" for k in MEASURES)]))


def write_ledger(docs: DataFrame, path: str) -> DataFrame:
    """The ledger with tk, which tells texts of one id apart, written to a path and read from it. It stays until it is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_rows(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *entries(part.column(2)).flatten()], names=["doc_id", "tk", *MEASURES])

    rows = docs.select("doc_id", text_key().alias("tk"), F.col("text").cast("string").alias("text"))
    return store(map_arrow(rows, run, ", ".join([id_ddl(docs), "tk long", *(f"{k} long" for k in MEASURES)])), path)


def keep_by(docs: DataFrame, ledger: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The documents that a policy keeps, by a ledger of them that write_ledger() wrote. They are read once and not judged."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE.mask | policy.mask)) != 0
    return without_rows(docs, ledger.filter(failed).select("doc_id", "tk").distinct())


def apply_policy(ledger: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    return ledger.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0,
        "kept": F.col("fail_bits").bitwiseAND(F.lit(BASE.mask | policy.mask)) == 0,
        "policy_version": F.lit(policy.version),
    })


def ablations(ledger: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only this rule rejects.

    Documents are first counted by bit pattern (at most 2^rules rows), so no text and no document is expanded by rule.
    """
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules)))
    rows = patterns.select("bits", "n", rules.alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def keep_good(docs: DataFrame, policy: Policy = PRODUCTION, path: str | None = None) -> DataFrame:
    """The documents that pass, with all their columns. The ledger is written to path; without one, to a folder that goes with release()."""
    return keep_by(docs, write_ledger(docs, path or new_path(docs.sparkSession, "ledger")), policy)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return apply_policy(evaluate(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: Every column of the query; 0x20, 0x09-0x0D as in the contract.
OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM l)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g),
h AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM c WHERE k > 1) GROUP BY r),
p AS (SELECT r, max(k)::BIGINT AS n FROM (SELECT r, count(*) AS k FROM (SELECT r, unnest(list_zip(w[:-2], w[2:])) AS z FROM l WHERE len(w) > 1) GROUP BY r, z) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(h.n, 0) AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x)))::BIGINT AS n_upper_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_letter_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣●]')))::BIGINT AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
         coalesce(p.n, 0) AS n_top_pair FROM l LEFT JOIN h ON l.r = h.r LEFT JOIN p ON l.r = p.r),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_upper_words > 60 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 60 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_letter_words < 70 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 128 ELSE 0 END
    + CASE WHEN 100 * n_ellipsis_lines > 30 * n_lines THEN 256 ELSE 0 END + CASE WHEN 200 * n_top_pair > 20 * n_words THEN 512 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, 3 AS policy_version FROM b
"""
