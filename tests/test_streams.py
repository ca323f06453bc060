import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import control, planning
from quarry.streaming import state


@pytest.fixture
def folder(spark, tmp_path):
    """An event log in three files, in order of time."""
    kinds = F.array(*map(F.lit, ["success", "success", "success", "rate_limited", "error", "timeout_signalled", "slow_success"]))
    log = spark.range(300).select(
        (F.col("id") % 5).alias("key"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.col("id").alias("event_id"), F.get(kinds, (F.xxhash64("id") % 7 + 6).cast("int") % 7).alias("outcome"), (F.col("id") % 13 + 0.5).alias("cost"),
    )
    path = f"{tmp_path}/events.parquet"
    for k in range(3):
        log.where(F.floor(F.col("event_id") / 100) == k).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def test_threads_survive_batches(spark, folder):
    live, log = stream(spark, folder)
    files = sorted((os.path.getmtime(os.path.join(folder, f)), f) for f in os.listdir(folder) if f.endswith(".parquet"))
    assert len(files) == 3
    out = state.drain(state.thread_counts(live.select("key", "ts", "event_id", "outcome")), "update")
    assert out.select("batch").distinct().count() == 3
    last = out.groupBy("key").agg(F.max_by(F.struct("threads", "streak", "observations"), "batch").alias("s")).select("key", "s.*")
    twin = control.thread_counts(log, "key", ["ts", "event_id"])
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, twin.collect()))


def test_cost_cap_survives_batches(spark, folder):
    live, log = stream(spark, folder)
    out = state.drain(state.cost_cap(live.select("key", F.col("event_id").alias("seq"), "cost"), 100.0), "append")
    twin = planning.running_cap(log, "key", ["event_id"], "cost", 100.0)
    assert sorted((r["key"], r["seq"]) for r in out.where("runs").collect()) == sorted((r["key"], r["event_id"]) for r in twin.collect())


def test_refresh_keeps_decisions(spark):
    known = spark.createDataFrame([("b", "old", "pending", 3), ("b", "no", "dismissed", 2), ("b", "yes", "added", 1)], "book string, term string, status string, n long")
    found = spark.createDataFrame([("b", "no", 9), ("b", "new", 4), ("c", "no", 5)], "book string, term string, n long")
    once = state.refresh_terms(known, found)
    want = [("b", "new", "pending", 4), ("b", "no", "dismissed", 2), ("b", "yes", "added", 1), ("c", "no", "pending", 5)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, state.refresh_terms(once, found).collect())) == want


def test_costs_in_batches_are_added_as_in_one_go(spark, tmp_path):
    """Doubles are added one by one over batches: 0.1, 0.1, 0.1 is above a cap of 0.3; a batch that runs again changes nothing."""
    from quarry.streaming import stateful

    rows = [[("a", 0, 0.1), ("b", 0, 0.3), (None, 0, 0.1)], [("a", 1, 0.1), ("a", 2, 0.1), ("c", 0, 0.2)], [("a", 3, 1.0), ("b", 1, 1.0), ("c", 1, 0.1), (None, 1, 0.1)]]
    sink = stateful.cost_cap_sink(f"{tmp_path}/store", 0.3)
    for k in (0, 1, 1, 2):
        sink(spark.createDataFrame(rows[k], "job string, seq long, cost double"), k)
    got = {(r["job"], r["seq"]): r["runs"] for r in stateful.read_log(spark, f"{tmp_path}/store/runs", stateful.RUNS).collect()}
    assert got == {**{(j, s): True for part in rows for j, s, _ in part}, ("a", 3): False}
