"""The jobs as queries: each runs its job twice into a new folder and returns the output read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import run_monitor, text_datasets
from quartzloom.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_text_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job1")
    for _ in range(2):
        text_datasets.build(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    return spark.read.parquet(f"{out}/rows").select("doc_id", "lang", "side", "source", "copies", "activity", "label", "scaffold", F.md5("text").alias("text_md5"))


def job2_run_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job2")
    for _ in range(2):
        run_monitor.monitor(spark, f"{sf_dir}/events.parquet", f"{out}/out", f"{out}/checkpoint")
    return run_monitor.runs(spark, f"{out}/out").drop("bucket")


JOB1_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, text, quality, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g')) AS canonical
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
o AS (SELECT lang, canonical, min(doc_id) AS doc_id, median(quality)::DOUBLE AS activity, count(DISTINCT doc_id) AS copies FROM d WHERE canonical <> '' GROUP BY lang, canonical),
f AS (SELECT DISTINCT ON (o.doc_id, o.lang) o.*, d.source, d.text, (activity > 0.5)::INTEGER AS label, md5(array_to_string(string_split(o.canonical, ' ')[1:5], ' ')) AS scaffold
  FROM o JOIN d ON d.doc_id = o.doc_id AND d.lang IS NOT DISTINCT FROM o.lang AND d.canonical = o.canonical),
z AS (SELECT lang, scaffold, count(*) AS k, min(doc_id) AS first FROM f GROUP BY lang, scaffold),
n AS (SELECT *, sum(k) OVER (PARTITION BY lang) AS n, coalesce(sum(k) OVER (PARTITION BY lang ORDER BY k, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM z),
t AS (SELECT *, below < greatest(floor(n * 0.2), 1) AS test FROM n),
s AS (SELECT *, CASE WHEN n < 3 OR count(*) FILTER (test) OVER (PARTITION BY lang) = 0 OR count(*) FILTER (NOT test) OVER (PARTITION BY lang) = 0 THEN 'train' WHEN test THEN 'test' ELSE 'train' END AS side FROM t)
SELECT f.doc_id, f.lang, s.side, f.source, f.copies, f.activity, f.label, f.scaffold, md5(f.text) AS text_md5 FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang AND f.scaffold = s.scaffold
"""

JOB2_SQL = """
WITH c AS (
  SELECT user_id AS run, ((i - 1) * 100)::INTEGER AS epoch, value / 100 AS val, least(1.0, i / 40.0)::DOUBLE AS train
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)),
g AS (SELECT run, epoch, train, last_value(val IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS val FROM c),
f AS (SELECT * FROM g WHERE val IS NOT NULL),
a AS (
  SELECT run, epoch, val, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run) AS n, avg(val) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm,
         avg(train) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS tt, count(train) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS tc FROM f WINDOW w AS (PARTITION BY run ORDER BY epoch)),
b AS (
  SELECT *, min(CASE WHEN tc = 5 AND tt > 0.5 AND n >= 20 THEN i END) OVER (PARTITION BY run) AS fi, min(CASE WHEN tc = 5 AND tt > 0.5 AND n >= 20 THEN epoch END) OVER (PARTITION BY run) AS mem,
         lead(sm, 5) OVER w AS s5, sum(sm) OVER (w ROWS BETWEEN 5 FOLLOWING AND 14 FOLLOWING) / 10 AS post FROM a WINDOW w AS (PARTITION BY run ORDER BY epoch)),
r AS (
  SELECT run, coalesce(max(mem), -1)::INTEGER AS mem, coalesce(min(CASE WHEN i > fi AND i < n - 15 AND sm < 0.5 AND i - fi > 5 AND s5 - sm > 0.05 AND post > 0.5 THEN epoch END), -1)::INTEGER AS event,
         coalesce(min(CASE WHEN val > 0.75 THEN epoch END), -1)::INTEGER AS initial FROM b WHERE n >= 60 GROUP BY run)
SELECT c.run, CASE WHEN r.run IS NULL THEN 'too_short' ELSE 'success' END AS status, mem, event, CASE WHEN mem <> -1 AND event <> -1 THEN event - mem WHEN mem IS NOT NULL THEN -1 END AS delay, event <> -1 AS detected, initial
FROM (SELECT DISTINCT run FROM c) c LEFT JOIN r ON r.run = c.run
"""

QUERIES = {"job1_text_datasets": job1_text_datasets, "job2_run_monitor": job2_run_monitor}
ORACLES = {"job1_text_datasets": JOB1_SQL, "job2_run_monitor": JOB2_SQL}
