"""Sources and sinks, by files written here."""

import json

import numpy as np
import pytest

from quartzloom.sources import plots, readers, sinks


def test_tsv_without_quotes(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('id\tKi (nM)\tname\n1\t>5\t"open\n2\t\tb\textra\n3\n')
    rows = readers.read_tsv(spark, str(p), ["id", "Ki (nM)", "name"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", ">5", '"open'), ("2", None, "b"), ("3", None, None)]


def test_csv_and_dispatch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    sinks.write_csv(df, str(tmp_path / "x.csv"))
    sinks.overwrite(df, str(tmp_path / "x.parquet"))
    assert readers.read_table(spark, str(tmp_path / "x.csv")).count() == 2
    assert readers.read_table(spark, str(tmp_path / "x.parquet")).columns == ["i", "s"]
    assert readers.read_parquets(spark, str(tmp_path / "x.parquet"), str(tmp_path / "x.parquet")).count() == 4
    assert readers.read_lake(spark, str(tmp_path / "x.parquet"), not_null=["s"]).count() == 2
    sinks.write_once(df.limit(1), str(tmp_path / "x.parquet"))
    assert spark.read.parquet(str(tmp_path / "x.parquet")).count() == 2


def test_index_and_blocks(spark, tmp_path):
    p = tmp_path / "index"
    p.write_text("# comment x y\n1abc 2.0 P1 more\n  2def 1.5 P2\nshort line\n")
    assert [tuple(r) for r in readers.read_index(spark, str(p)).orderBy("id").collect()] == [("1abc", "P1"), ("2def", "P2")]
    df = spark.createDataFrame([("x", "Pocket 1 :\n\tScore : 0.5\n\tKind : big\nPocket 2 :\n\tVolume : 3\n\tVolume : 4\n"), ("y", "nothing")], "id string, value string")
    rows = readers.parse_blocks(df, keys=["Score", "Volume", "Kind"]).orderBy("block").collect()
    assert [tuple(r) for r in rows] == [("x", 1, 0.5, None, None), ("x", 2, None, 4.0, None)]
    assert [r["texts"] for r in readers.parse_blocks(df).orderBy("block").collect()][0] == {"Score": "0.5", "Kind": "big"}


def test_run_logs(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"{n}.csv").write_text("# Config: {}\nepoch,train_auc\n100,0.5\n200,\n")
    (tmp_path / "notes.txt").write_text("x")
    df = readers.read_run_logs(spark, str(tmp_path / "*.csv"))
    assert sorted(tuple(r) for r in df.select("run_name", "epoch").collect()) == [("a", 100), ("a", 200), ("b", 100), ("b", 200)]
    assert [r["name"] for r in readers.list_files(spark, str(tmp_path)).collect()] == ["a.csv", "b.csv"]
    (tmp_path / "T1").mkdir()
    assert [r["name"] for r in readers.list_files(spark, str(tmp_path), folders=True).collect()] == ["T1"]
    with pytest.raises(ValueError):
        readers.require(df, ["epoch", "val_auc"])


def test_tasks_and_config(spark, tmp_path):
    (tmp_path / "t.csv").write_text("target,seed\na,1\n")
    assert readers.read_tasks(spark, str(tmp_path / "t.csv"), epochs=5).first().asDict() == {"target": "a", "seed": 1, "epochs": 5}
    (tmp_path / "c.json").write_text(json.dumps([{"hierarchy_levels": [3, 5], "split_method": "x", "max_actives_per_target": 20}]))
    c = readers.read_config(str(tmp_path / "c.json"))[0]
    assert (c.hierarchy_levels, c.n_folds, c.n_stochastic_splits, c.max_actives_per_target) == ([3, 5], 5, 1, 20)


def test_archive(spark, tmp_path):
    np.savez_compressed(tmp_path / "v.npz", P1_A1B=np.arange(3.0), P2_C2D=np.ones(2))
    rows = {r["target_id"]: r["vec"] for r in readers.read_archive(spark, str(tmp_path / "v.npz")).collect()}
    assert rows == {"P1_A1B": [0, 1, 2], "P2_C2D": [1, 1]}
    sinks.write_vectors(readers.read_archive(spark, str(tmp_path / "v.npz")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).select("target_id").count() == 2


def test_statements(spark):
    spark.createDataFrame([(1, 2, "SUBSET OF"), (1, 3, "OTHER")], "tid long, related_tid long, relationship string").createOrReplaceTempView("target_relations")
    assert [tuple(r) for r in readers.sql_scan(spark, "relations").collect()] == [(1, 2)]


def test_providers_are_tried_again(spark):
    def provider(key):
        if key == "bad":
            raise ConnectionError("down")
        return {"seq": key * 2}

    df = spark.createDataFrame([("a",), ("bad",), ("a",), (None,)], "k string")
    rows = sorted(((r["k"], r["payload"], r["status"]) for r in readers.fetch(df, provider, "k", wait=0).collect()), key=str)
    assert rows.count(("a", '{"seq": "aa"}', "ok")) == 2 and ("bad", None, "error: down") in rows and (None, None, None) in rows


def test_programs(spark):
    df = spark.createDataFrame([("ok",), ("slow",), ("fail",), ("gone",)], "k string")
    command = lambda k: {"ok": ["echo", "hi"], "slow": ["sleep", "5"], "fail": ["false"], "gone": ["no-such-program"]}[k]
    rows = {r["k"]: (r["output"], r["status"]) for r in readers.run_program(df, command, "k", timeout=1).collect()}
    assert rows["ok"] == ("hi\n", "success") and rows["slow"][1] == "timeout" and rows["fail"][1].startswith("failed") and rows["gone"][1] == "missing"


def test_program_results_are_cached(spark, tmp_path):
    calls = tmp_path / "calls"
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("bad",), (None,)], "k string")
    command = lambda k: ["sh", "-c", f"echo {k} >> {calls}; test {k} != bad && echo out-{k}"]
    for status in ("success", "cached"):
        rows = {r["k"]: (r["output"], r["status"]) for r in readers.run_program(df, command, "k", cache=str(tmp_path / "cache")).collect()}
        assert rows.pop("bad")[1].startswith("failed") and rows == {"a": ("out-a\n", status), "b": ("out-b\n", status)}
    assert sorted(calls.read_text().split()) == ["a", "b", "bad", "bad"]


def test_run_logs(spark, tmp_path):
    df = spark.createDataFrame([("x", e, e / 10) for e in range(30)] + [("y", 0, None)], "run string, epoch int, loss double")
    sinks.write_run_logs(df, str(tmp_path / "logs"), "lr=1")
    text = next((tmp_path / "logs/run=x").glob("part*")).read_text().splitlines()
    assert text[:3] == ["# Config: lr=1", "epoch,loss", "0,0.0"] and len(text) == 32 and text[-1] == "29,2.9"
    back = readers.read_run_logs(spark, str(tmp_path / "logs"), "epoch int, loss double").select("run", "epoch", "loss")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    log = sinks.RunLog(str(tmp_path / "own/run.csv"), {"lr": 1}, every=2)
    for e in range(3):
        log.log({"loss": e}, e)
        assert len((tmp_path / "own/run.csv").read_text().splitlines()) == (1, 4, 4)[e]
    log.finish()
    assert (tmp_path / "own/run.csv").read_text() == "# Config: {'lr': 1}\nepoch,loss\n0,0\n1,1\n2,2\n"


def test_run_logs_of_many_runs_share_files(spark, tmp_path):
    names = [*(f"r{i}" for i in range(300)), 'a,"b', "#c", None, "back\\slash"]
    df = spark.createDataFrame([(n, e, None if e == 2 else e / 10) for n in names for e in (10, 2, 0)], "run string, epoch int, loss double")
    sinks.write_run_logs(df, str(tmp_path / "logs"), "lr=1", parts=3)
    files = list((tmp_path / "logs").rglob("part-*"))
    assert len(files) == 3
    for f in files:
        lines = f.read_text().splitlines()
        assert lines[:2] == ["# Config: lr=1", "run,epoch,loss"] and not any(x.startswith(("#", "run,")) for x in lines[2:])
        runs = [x.rsplit(",", 2)[0] for x in lines[2:]]
        assert [x.rsplit(",", 2)[1] for x in lines[2:]] == ["0", "2", "10"] * (len(runs) // 3) and len(set(runs)) == len(runs) // 3
    back = readers.read_run_logs(spark, str(tmp_path / "logs"), "run string, epoch int, loss double").select("run", "epoch", "loss")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_run_log_scan_writes_no_file_for_each_run(spark, tmp_path, monkeypatch):
    from quartzloom.plans.catalog import QUERIES

    spark.range(2000).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "id div 2 as user_id", "id / 3D as value").write.parquet(str(tmp_path / "events.parquet"))
    seen, read = [], readers.read_run_logs
    monkeypatch.setattr(readers, "read_run_logs", lambda s, p, *a: seen.append(len(read(s, p, *a).inputFiles())) or read(s, p, *a))
    rows = QUERIES["run_log_scan"](spark, str(tmp_path)).collect()
    assert len(rows) == 2000 and {tuple(r) for r in rows} == {(i // 2, i % 2, round(i / 3, 3)) for i in range(2000)}
    assert seen[0] <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_plots(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, True), (2.0, 1.0, None, True), (3.0, 3.0, None, False), (None, 1.0, 1.0, True)], "volume_mean double, sasa_mean double, average_delay double, detected boolean")
    for detected, points in ((None, 1), ("detected", 3)):
        page = plots.scatter(df, "volume_mean", "sasa_mean", "average_delay", detected)
        assert page.startswith(b"%PDF-1.4") and page.count(b" m ") >= points and b"Sasa Mean \\(nm2\\)" in page
        assert page.count(b" c B") + page.count(b" c S") == points
    assert int(page[page.rindex(b"startxref") + 10 :].split()[0]) == page.index(b"xref\n")
    logs = spark.createDataFrame([("a", e, e / 10, e / 20) for e in range(10)], "run string, epoch int, train_accuracy double, validation_accuracy double")
    chosen = spark.createDataFrame([("Longest Delay (300)", "a", 2, -1), ("Lost", "gone", -1, -1)], "label string, run string, mem int, event int")
    page = plots.curves(logs, chosen, 100)
    assert page.count(b"[2 2] 0 d") == 1 and page.count(b"[6 3] 0 d") == 0 and b"no log of gone" in page and b"Longest Delay \\(300\\)" in page
    plots.write_bytes(spark, page, str(tmp_path / "f.pdf"))
    assert (tmp_path / "f.pdf").read_bytes() == page


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", 1, [1, 2]), ("a", "test", 2, [1, 3]), ("b", "train", 3, [2, 1])], "u string, split string, x int, path array<int>")
    sinks.write_csv_by(df.drop("path"), str(tmp_path / "by"), "u", "split")
    assert spark.read.csv(str(tmp_path / "by/u=a/split=test"), header=True).first()["x"] == "2"
    sinks.write_paths(df, str(tmp_path / "paths"), "u", "path")
    assert {r["hierarchy_path"] for r in spark.read.csv(str(tmp_path / "paths"), header=True).collect()} == {"1;2", "1;3", "2;1"}
    assert sinks.write_level(df, str(tmp_path), 5, 3, "train").endswith("k5_from_k3_train.parquet")
    assert sinks.write_level(df.filter("false"), str(tmp_path), 5, 5, "test") is None
    sinks.write_lines(df, str(tmp_path / "lines"), "x")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["1", "2", "3"]
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    sinks.write_chunks(df.selectExpr("u", "x as chunk"), str(tmp_path / "chunks"))
    assert spark.read.csv(str(tmp_path / "chunks"), header=True).count() == 3
    assert sinks.summary(df.select("u", "x").limit(1)).splitlines()[1] == "|-|-|"
    sinks.save_model(df.withColumnRenamed("split", "optimizer"), str(tmp_path / "model"))
    assert spark.read.parquet(str(tmp_path / "model")).columns == ["u", "x", "path"]
