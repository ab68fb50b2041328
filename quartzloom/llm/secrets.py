"""Secret scans over a ledger of blobs, with DataFrame functions only.

A blob is a text by its SHA-256. The ledger has rows (blob, rules, spans): the rule versions that
were applied to a blob, and what they found. A scan takes the digests of all texts first, drops
the (blob, rule version) pairs that the ledger has, reads the texts of the rest only, and returns
the new rows: see ``store.unseen``, texts are not shuffled as long as what is to be left out or to
be taken can be broadcast. ``SecretLedger`` keeps ledger and history in a shared folder: each batch
(a commit, a crawl) adds a row (key columns, blob) for every version of every path, and findings
are joined back to all of them without a text being read again.

Spans come from two passes of one expression: the pieces between matches and the matches
themselves; their lengths add up to code-point offsets.

Defined cases: a null text is empty and has no span; texts of any length are whole; repeated texts
are scanned once and each row gets the spans; a null doc_id stays null, ids may be of any type;
ties in start are listed in the order of RULES; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzloom.llm.common import cut
from quartzloom.llm.store import BatchTable, digest, unseen


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    version: int = 1
    #: The group whose length counts, its least length, and an expression that any match needs.
    group: int = 0
    least: int = 1
    hint: str = ""
    #: The group that stands before the span; 0 for none.
    lead: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


def either(word: str) -> str:
    """A word in either case, ASCII letters only."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key")
#: In the order in which kinds are listed. Runs of a class are maximal, so {n,} finds those of n or more that + finds.
RULES = (
    Rule("assign", f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=8, hint=f"({NAMES})[\"']?\\x20*[:=]"),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    # only where a run of the class begins: a start at every eyJ of a run would take time with its square
    Rule("jwt", "(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}", version=2, lead=1, hint="[.]eyJ"),
)
BASE = ("assign", "access", "hex")
#: Matches of a text that are placed at a time.
CHUNK = 512
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,rule:string>>"


def spans(text: Column, rule: Rule, number: int) -> Column:
    """All spans of a rule, leftmost and non-overlapping, in order."""
    regex = F.lit(rule.regex)
    lengths = lambda a: F.transform(a, F.length)
    parts = F.arrays_zip(
        lengths(F.split(text, rule.regex, -1)).alias("before"),
        lengths(F.regexp_extract_all(text, regex, 0)).alias("whole"),
        lengths(F.regexp_extract_all(text, regex, rule.group)).alias("value"),
        *([lengths(F.regexp_extract_all(text, regex, rule.lead)).alias("lead")] if rule.lead else []),
    )
    parts = F.filter(parts, lambda x: x["whole"].isNotNull())
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["before"]
        first = start + x["lead"] if rule.lead else start
        found = F.struct(first.alias("start"), F.lit(number).alias("kind_no"), (start + x["whole"]).alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"))
        return F.struct((start + x["whole"]).alias("at"), F.when(x["value"] >= rule.least, F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def of_parts(p: Column) -> Column:
        """In chunks, as appending copies an array: where each chunk starts, then each chunk by itself."""
        heads = F.sequence(F.lit(1), F.size(p), F.lit(CHUNK))
        longs = F.transform(heads, lambda i: F.aggregate(F.slice(p, i, F.lit(CHUNK)), F.lit(0), lambda n, x: n + x["before"] + x["whole"]))
        starts = F.aggregate(longs, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        run = lambda q, at: F.aggregate(q, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        many = F.flatten(F.transform(F.arrays_zip(heads.alias("head"), F.slice(starts, F.lit(1), F.size(heads)).alias("at")), lambda c: run(F.slice(p, c["head"], F.lit(CHUNK)), c["at"])))
        return F.when(F.size(p) <= CHUNK, run(p, F.lit(0))).otherwise(many)

    out = F.transform(F.array(parts), of_parts)[0]
    return F.when(text.rlike(rule.hint or rule.regex), out).otherwise(none)


LEDGER = f"blob binary, rules array<string>, spans {SPAN}"


def keys_of(rules: tuple[Rule, ...]) -> list[str]:
    return [r.key for r in rules]


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, ident: str = "doc_id") -> DataFrame:
    """New ledger rows (blob, rules, spans), for pairs of a blob and a rule version that the ledger lacks."""
    seen = None if ledger is None else ledger.select(F.col("blob").alias("digest"), F.col("rules").alias("done"))
    texts = unseen(docs, keys_of(rules), seen, ident)
    due = [F.col("todo").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(rules))]
    each = [F.when(due[i], spans(F.col("text"), r, i)).otherwise(F.array().cast(SPAN)) for i, r in enumerate(rules)]
    found = texts.select("digest", "todo", F.concat(*each).alias("spans")).groupBy("digest").agg(F.first("todo").alias("todo"), F.first("spans").alias("spans"))
    applied = F.array_compact(F.array(*(F.when(due[i], F.lit(r.key)) for i, r in enumerate(rules))))
    return found.select(F.col("digest").alias("blob"), applied.alias("rules"), "spans")


def joined(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """versions (..., blob) with spans of the given rule versions in place of blob, by start and kind."""
    current = F.array(*map(F.lit, keys_of(rules)))
    held = ledger.select("blob", F.filter("spans", lambda s: F.array_contains(current, s["rule"])).alias("spans")).filter(F.size("spans") > 0)
    held = cut(held.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))
    return versions.join(held, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN))).drop("blob")


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keys, spans) for each row of docs."""
    return joined(docs.select(*keys, digest().alias("blob")), ledger, rules)


class SecretLedger:
    """A durable ledger and the history of the paths that held each blob.

    keys: the columns that name a version, such as a path and a commit, with their types.
    """

    def __init__(self, spark: SparkSession, path: str, keys: str = "path string, commit string"):
        self.blobs = BatchTable(spark, f"{path.rstrip('/')}/blobs", LEDGER)
        self.versions = BatchTable(spark, f"{path.rstrip('/')}/versions", f"{keys}, blob binary")
        self.keys = [k.split()[0] for k in keys.split(",")]

    def add(self, batch: str, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what is unseen in a batch with columns keys and text. After a failure, calling this again completes the batch."""
        self.blobs.append(batch, scan(docs, self.blobs.read(), rules, self.keys[0]))
        self.versions.append(batch, docs.select(*self.keys, digest().alias("blob")))

    def rescan(self, batch: str, docs: DataFrame, rules: tuple[Rule, ...]) -> None:
        """Apply new rule versions to texts whose versions the history has."""
        self.blobs.append(batch, scan(docs, self.blobs.read(), rules, self.keys[0]))

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(*keys, spans) for every version of every path."""
        return joined(self.versions.read(), self.blobs.read(), rules)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = findings(docs, cut(scan(docs)))  # the first batch of a ledger: every blob is unseen
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        x = "'" + r.regex.replace("'", "''") + "'"
        parts.append(f"""
  SELECT r, {i} AS kind_no, '{r.kind}' AS kind, unnest(list_zip(range(1, len(m) + 1), m, v, {"w" if r.lead else "list_transform(m, lambda x: '')"})) AS z, p, m, {r.least} AS least
  FROM (SELECT r, string_split_regex(t, {x}) AS p, regexp_extract_all(t, {x}, 0) AS m, regexp_extract_all(t, {x}, {r.group}) AS v{f", regexp_extract_all(t, {x}, {r.lead}) AS w" if r.lead else ""} FROM d)""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
s AS ({' UNION ALL'.join(parts)}),
o AS (
  SELECT r, kind_no, kind, least, length(z[3]) AS value, length(z[2]) AS whole, length(z[4]) AS lead,
         (list_sum(list_transform(p[1:z[1]], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:z[1] - 1], lambda x: length(x))), 0))::BIGINT AS start FROM s),
k AS (SELECT r, kind_no, kind, start + lead AS start, kind || ':' || (start + lead) || ':' || (start + whole) AS span FROM o WHERE value >= least)
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access, count(*) FILTER (kind = 'hex')::BIGINT AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind_no), '') AS spans
FROM d LEFT JOIN k ON d.r = k.r GROUP BY d.r
"""


OP4_SQL = _sql()
