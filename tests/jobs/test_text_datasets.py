"""The dataset job against a plain version, run again, and from the command line."""

import hashlib
import json
import os
import random
import re
import statistics
import subprocess
import sys
from collections import defaultdict

import duckdb
import pytest

from jobs import queries, text_datasets
from jobs.common import checked, settings

DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def corpus():
    r = random.Random(4)
    words = [r.choice("abcdeé") * r.randint(1, 3) for _ in range(30)]
    docs, labels = [], []
    for i in range(300):
        start = r.choice(["One and the same opening here", "Other first words", ""])
        text = r.choice([None, " \n\t", f"{start} {' '.join(r.choices(words, k=r.randint(0, 4)))}", f"{start.upper()}\n\n {r.choice(words)}  x"])
        docs.append((i, text, r.choice(["en", "en", "de", None]), f"s{i % 3}", "extra"))
        labels += [(i, r.choice([0, 1, None])) for _ in range(r.choice([0, 1, 1, 2]))]
    return docs + docs[:3], labels


def slow(docs, labels, test_size=0.2, words=5):
    marks = defaultdict(list)
    for i, q in labels:
        if q is not None:
            marks[i].append(q)
    groups = defaultdict(list)
    for i, text, lang, source, _ in docs:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        key = re.sub("[\x09-\x0d\x20]+", " ", lower).strip(" ")
        if key and marks[i]:
            groups[lang, key].append((i, text, source, marks[i]))
    out, by = {}, defaultdict(lambda: defaultdict(list))
    for (lang, key), rows in groups.items():
        i, text, source, _ = min(rows)
        activity = statistics.median([q for *_, qs in rows for q in qs])
        scaffold = hashlib.md5(" ".join(key.split(" ")[:words]).encode()).hexdigest()
        out[i] = [lang, None, source, text, len({r[0] for r in rows}), activity, int(activity > 0.5), scaffold]
        by[lang][scaffold].append(i)
    for lang, scaffolds in by.items():
        n, test = sum(map(len, scaffolds.values())), []
        for s in sorted(scaffolds, key=lambda s: (len(scaffolds[s]), min(scaffolds[s]))):
            if len(test) < max(1, int(n * test_size)):
                test += scaffolds[s]
        whole = n < 3 or len(test) in (0, n)
        for ids in scaffolds.values():
            for i in ids:
                out[i][1] = "test" if i in test and not whole else "train"
    return {i: tuple(r) for i, r in out.items()}


def stored(spark, out):
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: (r["lang"], r["side"], r["source"], r["text"], r["copies"], r["activity"], r["label"], r["scaffold"]) for r in rows}


def test_build(spark, tmp_path):
    docs, labels = corpus()
    d, k, out = (str(tmp_path / x) for x in ("d", "k", "out"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, activity string").write.parquet(d)
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(k)
    told = text_datasets.build(spark, d, k, out)
    want = slow(docs, labels)
    assert stored(spark, out) == want and told["written"] == len(want) and told["documents"] == sum(r[4] for r in want.values())
    assert {r[1] for r in want.values()} == {"train", "test"} and None in {r[0] for r in want.values()}
    assert text_datasets.build(spark, d, k, out) == told and stored(spark, out) == want
    summary = spark.read.json(f"{out}/summary").collect()
    assert sum(r["n_rows"] for r in summary) == len(want) and sum(r["n_positive"] for r in summary) == sum(r[6] for r in want.values())
    # other settings replace what was there
    capped = text_datasets.build(spark, d, k, out, {"max_per_target": 5, "opening_words": 2})
    assert capped["written"] == sum(min(5, sum(r[0] == x for r in want.values())) for x in {r[0] for r in want.values()}) == spark.read.parquet(f"{out}/rows").count()


def test_no_labels(spark, tmp_path):
    d, k, out = (str(tmp_path / x) for x in ("d", "k", "out"))
    spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(d)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(k)
    assert text_datasets.build(spark, d, k, out) == {"read": 0, "blank": 0, "written": 0, "documents": 0}


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"test_size": 0.5}))
    assert settings(spark, f"file://{tmp_path}/c.json", text_datasets.DEFAULTS)["test_size"] == 0.5
    assert settings(spark, f"{ROOT}/jobs/text_datasets.json", text_datasets.DEFAULTS) == text_datasets.DEFAULTS
    with pytest.raises(ValueError, match="unknown settings: size"):
        checked({"size": 1}, text_datasets.DEFAULTS)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "events"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    df, rel = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr) and got
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_command_line(tmp_path):
    out = tmp_path / "out"
    done = subprocess.run([sys.executable, "-m", "jobs.text_datasets", "--documents", f"{DIR}/documents.parquet", "--labels", f"{DIR}/labels.parquet", "--out", str(out), "--config", f"{ROOT}/jobs/text_datasets.json"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "labelled documents" in done.stderr and list(out.glob("rows/lang=*/side=*/*.parquet"))
