"""Streams of runs give what the batch functions give, also when a run is repeated after a crash."""

import shutil

import pytest

from lakewarden.operators.rules import Rule
from lakewarden.operators.screening import screen_backlog
from lakewarden.streaming import alerts, runs

DAYS = [[(1, "a"), (2, "b"), (2, "b")], [(2, "b"), (3, "c")], [(2, "b")], [(1, "z"), (3, "c")], [(3, None), (1, "a")]]


def put(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"in/d={number}"))


def feed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))


def told(spark, folder, columns):
    rows = spark.read.option("basePath", str(folder / "told")).parquet(str(folder / "told")).select("run", *columns)
    return sorted(map(tuple, rows.collect()), key=repr)


def crash(folder, number):
    """The run wrote its files, but its end was never committed; half of what it told was lost too."""
    for p in (folder / "checkpoint/commits").glob(f"*{number}*"):
        p.unlink()
    shutil.rmtree(folder / f"told/run={number}")


@pytest.mark.parametrize("crashes", [(), (1, 3), (0, 2, 4)])
def test_alert_runs(spark, tmp_path, crashes):
    schema, state, want = "id int, s string", spark.createDataFrame([], "fingerprint string"), []
    for i, day in enumerate(DAYS):
        put(spark, tmp_path, i, day, schema)
        runs.alert_runs(feed(spark, tmp_path, schema), ["id", "s"], str(tmp_path)).awaitTermination()
        if i in crashes:
            crash(tmp_path, i)
            runs.alert_runs(feed(spark, tmp_path, schema), ["id", "s"], str(tmp_path)).awaitTermination()
        new, state = alerts.since_last_run(spark.createDataFrame(day, schema), state)
        want += [(i, r.id, r.s) for r in new.collect()]
        state = spark.createDataFrame(state.collect(), "fingerprint string")
    assert told(spark, tmp_path, ["id", "s"]) == sorted(want, key=repr) and len(want) > 4
    assert sorted(int(p.name) for p in (tmp_path / "state").iterdir()) == [3, 4]


@pytest.mark.parametrize("crashes", [(), (0, 1, 3)])
def test_change_runs(spark, tmp_path, crashes):
    schema = "id int, s string"
    for i, day in enumerate(DAYS):
        put(spark, tmp_path, i, day, schema)
        runs.change_runs(feed(spark, tmp_path, schema), ["id"], ["id", "s"], str(tmp_path)).awaitTermination()
        if i in crashes:
            crash(tmp_path, i)
            runs.change_runs(feed(spark, tmp_path, schema), ["id"], ["id", "s"], str(tmp_path)).awaitTermination()
    want, seen = [], {}
    for i, day in enumerate(DAYS):
        for k, s in dict(day).items():
            want.append((i, k, "new" if k not in seen else "unchanged" if seen[k] == s else "updated"))
            seen[k] = s
    assert told(spark, tmp_path, ["id", "op"]) == sorted(want)


def test_screen_on_insert(spark, tmp_path):
    """Rows, late ones among them, are screened once each with a looked-up field, as in one batch."""
    schema = "account int, amount double, state string, rule_id int, day date"
    rules = [Rule(1, 1, "high", "amount > 10"), Rule(2, 2, "low", "balance < 0")]
    known = spark.createDataFrame([(1, -5.0), (2, 7.0)], "account int, balance double")
    import datetime

    on = datetime.date
    days = [[(1, 20.0, "new", None, on(2024, 1, 1)), (3, 1.0, "new", None, on(2024, 1, 2))], [(2, 11.0, "new", None, on(2023, 5, 1)), (1, 1.0, "done", None, on(2024, 1, 3))], [(1, 20.0, "new", None, on(2024, 1, 1))]]
    for i, day in enumerate(days):
        put(spark, tmp_path, i, day, schema)
        runs.screen_on_insert(feed(spark, tmp_path, schema), rules, str(tmp_path), known, "account").awaitTermination()
        if i == 1:
            crash(tmp_path, i)
    runs.screen_on_insert(feed(spark, tmp_path, schema), rules, str(tmp_path), known, "account").awaitTermination()
    whole = spark.createDataFrame([r for d in days for r in d], schema).join(known, "account", "left")
    columns = ["account", "amount", "rule_id", "state"]
    want = sorted((tuple(r[c] for c in columns) for r in screen_backlog(whole, rules).collect()), key=repr)
    assert [r[1:] for r in sorted(told(spark, tmp_path, columns), key=lambda r: repr(r[1:]))] == want and any(r[2] == 2 for r in want)
