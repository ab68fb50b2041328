"""The monitor over events that grow, stop and come again."""

import random
from datetime import datetime, timedelta

import pytest

from jobs import run_monitor

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(n=6000):
    r = random.Random(9)
    start, rows = datetime(2024, 1, 1), []
    for i in range(n):
        user = r.choice([None, *range(30), *range(5)])
        value = None if r.random() < 0.05 else 100 * r.random() * (0.4 if i < n * 0.6 else 1)
        rows.append((i, start + timedelta(minutes=i // 2), user, r.choice("ab"), value, "x"))
    r.shuffle(rows)
    return rows


def put(spark, rows, path, name):
    """Adds a file to a folder, all at once."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def whole(spark, rows, c):
    points = run_monitor.points_of(spark.createDataFrame(rows, SCHEMA), c["buckets"])
    return {tuple(r) for r in run_monitor.analysis(points, c).collect()}


def stored(spark, out):
    rows = run_monitor.runs(spark, out).select("run", "status", "mem", "event", "delay", "detected", "initial", "bucket").collect()
    assert len({r["run"] for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / x) for x in ("events", "out", "checkpoint")]


def test_growing_input(spark, folders):
    rows, (src, out, check) = events(), folders
    c = run_monitor.DEFAULTS | {"buckets": 4}
    put(spark, rows[:2500], src, 0)
    assert run_monitor.monitor(spark, src, out, check, {"buckets": 4})["read"] == 2500
    assert stored(spark, out) == whole(spark, rows[:2500], c)
    again = run_monitor.monitor(spark, src, out, check, {"buckets": 4})
    assert again["batches"] == again["read"] == 0 and stored(spark, out) == whole(spark, rows[:2500], c)
    put(spark, rows[2500:4000], src, 1)
    put(spark, rows[4000:], src, 2)
    told = run_monitor.monitor(spark, src, out, check, {"buckets": 4, "files_per_batch": 1})
    assert (told["batches"], told["read"]) == (2, 3500)
    got = stored(spark, out)
    assert got == whole(spark, rows, c) and any(r[5] for r in got) and any(r[1] == "too_short" for r in got | {(0, "too_short")})


def test_only_touched_buckets_are_written(spark, folders):
    src, out, check = folders
    rows = events()
    put(spark, rows, src, 0)
    run_monitor.monitor(spark, src, out, check)
    files = lambda: {r["f"] for r in spark.read.parquet(f"{out}/runs").selectExpr("input_file_name() as f").distinct().collect()}
    before = files()
    put(spark, [(99_999, datetime(2030, 1, 1), 3, "a", 50.0, "x")], src, 1)
    run_monitor.monitor(spark, src, out, check)
    kept = files() & before
    (bucket,) = {r[-1] for r in stored(spark, out) if r[0] == 3}
    assert kept == {f for f in before if f"bucket={bucket}/" not in f}


def test_failed_batch_is_taken_again(spark, folders, monkeypatch):
    rows, (src, out, check) = events(1500), folders
    put(spark, rows[:700], src, 0)
    run_monitor.monitor(spark, src, out, check)
    put(spark, rows[700:], src, 1)

    def lost(*_):
        raise OSError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(run_monitor, "partitioned", lost)  # after the points of the batch are written
        with pytest.raises(Exception, match="executor lost"):
            run_monitor.monitor(spark, src, out, check)
    assert run_monitor.monitor(spark, src, out, check)["read"] == 800
    assert stored(spark, out) == whole(spark, rows, run_monitor.DEFAULTS)


def test_other_buckets_are_refused(spark, folders):
    src, out, check = folders
    put(spark, events(100), src, 0)
    run_monitor.monitor(spark, src, out, check)
    with pytest.raises(ValueError, match="16 buckets, not 8"):
        run_monitor.monitor(spark, src, out, check, {"buckets": 8})


def test_no_events(spark, folders):
    src, out, check = folders
    put(spark, [], src, 0)
    assert run_monitor.monitor(spark, src, out, check)["runs"] == 0


def test_one_file(spark, folders, tmp_path):
    """A path may be one file, as the given tables are at small sizes."""
    rows, (src, out, check) = events(1500), folders
    put(spark, rows, src, 0)
    file = tmp_path / "table-1.parquet"
    next(tmp_path.glob("events/*.parquet")).rename(file)
    c = run_monitor.DEFAULTS
    assert run_monitor.monitor(spark, str(file), out, check)["read"] == 1500
    assert stored(spark, out) == whole(spark, rows, c)
    assert run_monitor.monitor(spark, str(file), out, check)["batches"] == 0
