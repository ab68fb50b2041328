"""The pipeline against a brute-force version of its stages."""

import os
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers
from test_llm_operators import brute_hits, brute_lines
from test_resemblance import near_classes
from tokenizers import Tokenizer

from quartzloom.llm import common, quality
from quartzloom.llm.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    good = {i for i, kept in db.execute(f"SELECT doc_id, kept FROM ({quality.OP2_SQL})").fetchall() if kept}
    rows = [r for r in rows if r["doc_id"] in good]
    rows = [r | {"text": w[2]} for r, w in zip(rows, brute_lines([r["text"] for r in rows], 10), strict=True)]
    first = {}
    for r, g in sorted(zip(rows, near_classes([r["text"] for r in rows]), strict=True), key=lambda x: x[0]["doc_id"]):
        first.setdefault(g, r)
    rows = [r for r in first.values() if not brute_hits(r["text"], items)[1]]
    model, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in rows:
        ids = [*model.encode(r["text"], add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 4096):
            want[r["doc_id"], i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[i : i + 4096]))] += 1
    assert len(rows) > 50
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, DIR).collect()) == want


def test_ledger_outlasts_the_run(spark, tmp_path):
    """Another policy takes its documents from the ledger of an earlier run, without judging or reading a text for it."""
    docs, path = spark.read.parquet(f"{DIR}/documents.parquet"), f"{tmp_path}/ledger"
    corpus_pipeline.run(spark, DIR, path).count()
    common.release(spark)
    ledger = spark.read.parquet(path)
    assert ledger.columns == ["doc_id", "tk", *quality.MEASURES]
    policy = quality.Policy(4, ("few_words",))
    plain = quality.apply_policy(quality.evaluate(docs), policy)
    assert sorted(r["doc_id"] for r in quality.keep_by(docs, ledger, policy).collect()) == sorted(r["doc_id"] for r in plain.filter("kept").collect())
    assert "text" not in {f.name for f in quality.apply_policy(ledger, policy).schema}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).schema.names == docs.columns
        assert stage(spark, docs.filter("false"), DIR).count() == 0


def test_every_query_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 13))
    assert set(ORACLES) <= set(QUERIES)
    assert os.path.exists(corpus_pipeline.__file__)
