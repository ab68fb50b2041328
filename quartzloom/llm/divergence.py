"""Source divergence audit: which sources of a language differ, and by which terms.

Sources of a language are compared by the shares of its terms, all in integers. Workers run SQL in
DuckDB over Arrow batches: terms of each batch are counted where the texts lie; Spark sums the counts
by (lang, source, term), so that a frequent term is spread by source and summed before it moves, and
deals the sums in shards by the hash of (lang, term). A shard keeps the terms of ``least`` documents or
more with their counts by source, then takes partial sums for each pair of sources, each group's
best terms, and how many terms have which count. Spark adds the sums up and ranks.

The value of a pair is a sum over all kept terms, of which most are in few sources. With p(c) for the
share of a count c, f(p(a), q(b)) = f(p(0), q(0)) + [f(p(a), q(0)) - f(p(0), q(0))] + [f(p(0), q(b)) - f(p(0), q(0))]
+ a rest that is zero unless both counts are positive. So a shard sums that rest over pairs of sources
that share a term, and the brackets need only the number of terms of each count in a source.

Defined cases: null texts, langs and sources are empty texts, and '' is a lang or source like any other;
a text without terms, or an empty one, still makes its group known; each row is a document, repeated
rows and copies included; texts of any length are read whole (long ones in pieces cut at the end of a
term); a lang without kept terms has pairs of value 0 and no terms; a lang of one source has no pair;
an empty table gives no rows; ids and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzloom.llm import common
from quartzloom.llm.common import cut, map_arrow

#: Documents of a language that a term must be in; terms listed for each group; what p is scaled to.
LEAST, TOP, SCALE = 10, 10, 1_000_000_000
#: Characters that separate terms: all ASCII but letters.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalpha())
GAP = re.compile("[^A-Za-z\x80-\U0010ffff]")
#: Characters of a text that DuckDB splits at a time, and rows of sums that a worker holds.
PIECE, HELD = 1 << 20, 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("cells", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))])
SUMS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("n", pa.int64()), ("value", pa.int64())])


def engine() -> duckdb.DuckDBPyConnection:
    """One thread, as a task has one core, and nothing on a local disk."""
    con = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "768MB"})
    con.sql("CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // (p + q)")
    con.sql(f"CREATE MACRO p(n, total, v) AS (1 + ({SCALE}::HUGEINT * (n + 2)) // (total + 2 * v))::BIGINT")
    return con


def emit(con: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema, **params: str) -> Iterator[pa.RecordBatch]:
    for batch in con.sql(sql, params=params or None).to_arrow_reader(20_000):
        yield from pa.Table.from_batches([batch]).rename_columns(schema.names).cast(schema).to_batches()


def pieces(text: str) -> list[str]:
    """The text in pieces of about PIECE characters, none of which cuts a term."""
    out, at = [], 0
    while len(text) - at > PIECE:
        gap = GAP.search(text, at + PIECE)
        if not gap:
            break
        out.append(text[at : gap.start()])
        at = gap.end()
    return [*out, text[at:]]


def in_pieces(batch: pa.RecordBatch) -> pa.Table:
    """(r, lang, source, text): r is the number of the row."""
    names, numbers = ["r", "lang", "source", "text"], pa.array(range(batch.num_rows), pa.int64())
    if pc.max(pc.utf8_length(batch.column(2))).as_py() <= PIECE:
        return pa.table([numbers, *batch.columns], names=names)
    cut_up = [(i, x) for i, t in enumerate(batch.column(2).to_pylist()) for x in pieces(t)]
    rows = pa.array([i for i, _ in cut_up], pa.int64())
    return pa.table([rows, batch.column(0).take(rows), batch.column(1).take(rows), pa.array([x for _, x in cut_up], pa.string())], names=names)


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a source, and its documents. A row with a null term stands for each group."""

    word = "unnest(string_split(translate(text, $upper || $gaps, $lower || repeat(' ', length($gaps))), ' '))"
    by_row = f"SELECT r, term, any_value(lang) AS lang, any_value(source) AS source, count(*) AS n FROM (SELECT *, {word} AS term FROM texts) WHERE term <> '' GROUP BY r, term"
    sql = f"SELECT lang, source, term, sum(n), count(*) FROM ({by_row}) GROUP BY ALL UNION ALL SELECT DISTINCT lang, source, NULL, 0, 0 FROM texts"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = engine()
        for batch in batches:
            if batch.num_rows:
                con.register("texts", in_pieces(batch))
                yield from emit(con, sql, COUNTS, upper=UPPER, lower=LOWER, gaps=GAPS)
                con.unregister("texts")

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = map_arrow(docs.select(text("lang"), text("source"), text("text")), run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def keep_terms(counts: DataFrame, least: int = LEAST, shards: int | None = None) -> DataFrame:
    """(lang, term, cells): the terms of ``least`` documents of a language or more, with their counts by source; null terms stand for groups.

    shards: spark.sql.shuffle.partitions unless given; a shard's counts must fit a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = engine()
        con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            con.execute("INSERT INTO counts SELECT * FROM batch")
            con.unregister("batch")
        yield from emit(con, f"SELECT lang, term, list(struct_pack(source := source, n := n)) FROM counts GROUP BY lang, term HAVING term IS NULL OR sum(docs) >= {least}", KEPT)

    n = shards or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(counts.repartition(n, "lang", "term"), run, "lang string, term string, cells array<struct<source string, n long>>")


def shard_sums(kept: DataFrame, top: int = TOP) -> DataFrame:
    """Partial results of tasks: part pair (source, item: n is null, value the rest over shared terms, source before item),
    part term (a group's best terms of the task), part count (n: a count, value: terms that have it in the source).

    kept: (lang, term, cells of (source, n, total), v, n_lang) with the totals of each group.
    """
    steps = (
        "CREATE OR REPLACE TEMP TABLE cells AS SELECT r, lang, term, v, c.source AS source, c.n AS n, p(c.n, c.total, v) AS p, p(0, c.total, v) AS zero, p(n_lang_term, n_lang, v) AS q "
        "FROM (SELECT r, lang, term, v, n_lang, list_sum([x.n for x in cells])::BIGINT AS n_lang_term, unnest(cells) AS c FROM (SELECT row_number() OVER () AS r, * FROM batch))",
        "INSERT INTO sums SELECT 'pair', a.lang, a.source, b.source, NULL, sum(f(a.p, b.p) - f(a.p, b.zero) - f(a.zero, b.p) + f(a.zero, b.zero))::BIGINT FROM cells a JOIN cells b ON a.r = b.r AND a.source < b.source GROUP BY ALL",
        "INSERT INTO sums SELECT 'count', lang, source, NULL, n, count(*) FROM cells GROUP BY ALL",
        "INSERT INTO sums SELECT 'term', lang, source, term, NULL, f(p, q) FROM cells WHERE p > q",
        f"CREATE OR REPLACE TABLE sums AS SELECT part, lang, source, item, n, sum(value)::BIGINT AS value FROM sums WHERE part <> 'term' GROUP BY ALL UNION ALL "
        f"(SELECT * FROM sums WHERE part = 'term' QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top})",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = engine()
        create = "CREATE OR REPLACE TABLE sums (part VARCHAR, lang VARCHAR, source VARCHAR, item VARCHAR, n BIGINT, value BIGINT)"
        con.execute(create)
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            for s in steps:
                con.execute(s)
            con.unregister("batch")
            if con.execute("SELECT count(*) FROM sums").fetchall()[0][0] > HELD:
                yield from emit(con, "FROM sums", SUMS)
                con.execute(create)
        yield from emit(con, "FROM sums", SUMS)

    return map_arrow(kept, run, "part string, lang string, source string, item string, n long, value long")


def share(n: Column, total: Column, v: Column) -> Column:
    """p of a count, exactly; null without kept terms."""
    wide, below = n.cast("decimal(19,0)") + 2, total + 2 * v
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide, F.when(below > 0, below).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group, all other sources of its language by divergence, and its best terms."""
    kept = cut(keep_terms(count_terms(docs), least, shards))
    cells = kept.select("lang", "term", F.explode("cells").alias("c")).select("lang", "term", "c.*")
    sizes = kept.groupBy("lang").agg(F.count("term").alias("v"))
    groups = cut(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(sizes, "lang"))
    few = F.broadcast if groups.count() <= common.BROADCAST_ROWS else (lambda df: df)

    langs = groups.groupBy("lang", "v").agg(F.map_from_entries(F.collect_list(F.struct("source", "total"))).alias("_totals"), F.sum("total").alias("n_lang"))
    rows = kept.filter("term is not null").join(few(langs), "lang")
    filled = F.transform("cells", lambda c: F.struct(c["source"].alias("source"), c["n"].alias("n"), F.col("_totals")[c["source"]].alias("total")))
    sums = cut(shard_sums(rows.select("lang", "term", filled.alias("cells"), "v", "n_lang"), top))

    zero = share(F.lit(0), F.col("total"), F.col("v"))
    own = groups.select("lang", "source", "v", zero.alias("_zero"))
    other = groups.select("lang", F.col("source").alias("item"), zero.alias("_other"))
    flat = F.coalesce(F.col("v") * gap(F.col("_zero"), F.col("_other")), F.lit(0))
    base = own.join(few(other), "lang").filter("source <> item").select("lang", "source", "item", flat.alias("value"))
    counts = sums.filter("part = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").alias("_k")).join(few(groups), ["lang", "source"])
    counts = counts.select("lang", "source", "_k", share(F.col("n"), F.col("total"), F.col("v")).alias("_p"), zero.alias("_zero"))
    one = counts.join(few(other), "lang").filter("source <> item").select("lang", "source", "item", (F.col("_k") * (gap(F.col("_p"), F.col("_other")) - gap(F.col("_zero"), F.col("_other")))).alias("value"))
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    swapped = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(one).unionByName(swapped(one)).unionByName(both).unionByName(swapped(both))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = sums.filter("part = 'term'").select("lang", "source", "item", "value", "part")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (s.total + 2 * l.v) AS p,
         1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM y QUALIFY part = 'pair' OR rank <= 10
"""
