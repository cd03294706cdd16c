from datetime import datetime, timedelta

import pytest

from recordloom.streaming import follow


def test_state_follows_commits_in_any_order(spark, tmp_path):
    schema = "type string, id string, commit int, kind string, hash string"
    src = str(tmp_path / "in")
    spark.createDataFrame([("t", "1", 3, "r", "c"), ("t", "2", 1, "r", "a")], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame([("t", "1", 2, "r", "b"), ("t", "2", 2, "x", None)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = follow.follow(spark, src, spark.read.parquet(src).schema, files=1)
    follow.keep_state(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["id"], r["commit"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "state/1")).collect()}
    assert got == {("1", 3, "r"), ("2", 2, "x")}


def test_usage_counts_a_delivery_once(spark, tmp_path):
    t = datetime(2024, 1, 1, 10)
    rows = [("r1", 0, 1, 7, "read", 5, t), ("r1", 0, 1, 7, "read", 5, t), ("r1", 1, 1, 7, "read", 2, t), ("r2", 0, 1, 7, "read", 1, t + timedelta(days=1)), ("r9", 0, 2, 7, "read", 1, t + timedelta(days=9))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "r string, i int, account int, collection int, metric string, amount long, ts timestamp").coalesce(1).write.parquet(src)
    out: list = []
    follow.run_now(follow.daily_usage(follow.follow(spark, src, spark.read.parquet(src).schema)), str(tmp_path / "cp"), lambda df, n: out.extend(df.collect()), "append")
    got = {(r["day"], r["account"], r["amount"]) for r in out}
    assert got == {("2024-01-01", 1, 7), ("2024-01-02", 1, 1)}  # the last day is still open


def test_gathered_streams(spark, tmp_path):
    t = datetime(2024, 1, 1, 10)
    rows = [("r1", n % 5, 1, 7, "read", 5, t + timedelta(days=n % 2)) for n in range(10)]
    src = str(tmp_path / "in")
    for k in range(2):
        spark.createDataFrame(rows[5 * k : 5 * k + 5], "r string, i int, account int, collection int, metric string, amount long, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = follow.follow(spark, src, spark.read.parquet(src).schema, files=1)
    assert follow.gathered(stream).count() == 10
    usage = follow.gathered(follow.daily_usage(stream, "9 days"), "update", ["day", "account", "collection", "metric"])
    assert sum(r["amount"] for r in usage.collect()) == 25  # five deliveries, each twice


def test_job_chains_go_on_where_they_stopped(spark, tmp_path):
    ran, ledger = [], f"file://{tmp_path}/ledger"

    def broken():
        ran.append("b")
        if ran.count("b") == 1:
            raise RuntimeError

    jobs = [("a", lambda: ran.append("a")), ("b", broken), ("c", lambda: ran.append("c"))]
    with pytest.raises(RuntimeError):
        follow.run_chain(spark, ledger, jobs)
    assert follow.run_chain(spark, ledger, jobs) == ["b", "c"] and follow.run_chain(spark, ledger, jobs) == []
    assert ran == ["a", "b", "b", "c"]


def test_retries_wait_twice_as_long_each_time(spark):
    tries = [("x", n, 0, False, False) for n in range(1, 5)] + [("y", 1, 0, False, True), ("z", 5, 0, False, False), ("w", 2, 0, True, False)]
    got = {r["delivery"]: (r["status"], r["next_at"]) for r in follow.retries(spark.createDataFrame(tries, "delivery string, attempt int, at long, ok boolean, terminal boolean")).collect()}
    assert got == {"x": ("again", 480), "y": ("given up", None), "z": ("given up", None), "w": ("delivered", None)}


def test_sessions_expire_when_idle(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("s", t), ("s", t + timedelta(hours=11)), ("s", t + timedelta(hours=30)), ("z", t + timedelta(days=9))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "session string, ts timestamp").coalesce(1).write.parquet(src)
    out: list = []
    follow.run_now(follow.idle_sessions(follow.follow(spark, src, spark.read.parquet(src).schema)), str(tmp_path / "cp"), lambda df, n: out.extend(df.collect()))
    assert sorted(r["uploads"] for r in out if r["session"] == "s") == [1, 2]
