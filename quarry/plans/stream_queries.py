"""Streams run over a table's files to their end; results equal the batch twins'."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import control
from quarry.plans import job_queries
from quarry.sources.shared import scratch, until_end
from quarry.sources.tables import table
from quarry.streaming import state, stateful


def stream_aimd_threads(spark, sf):
    e = state.replay(spark, sf, "events")
    code = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") != "signup", 0)
    found = control.outcome(code, F.when(F.col("event_id") % 7 == 0, 1).otherwise(0), F.col("value"), F.lit(20.0))
    out = state.drain(state.thread_counts(e.select(F.col("user_id").alias("key"), "ts", "event_id", found.alias("outcome"))), "update")
    last = out.groupBy("key").agg(F.max_by(F.struct("threads", "streak", "observations"), "batch").alias("s"))
    return last.select(F.col("key").alias("user_id"), "s.threads", "s.streak", "s.observations")


def _runs(spark, parts, make, sink, mode, state_parts=None):
    """Start a stream again and again on one checkpoint, with more files each time."""
    folder, checkpoint = scratch(spark, "stream-in"), scratch(spark, "stream-state")
    for part in parts:
        part.write.mode("append").parquet(folder)
        live = spark.readStream.schema(part.schema).parquet(folder)
        stateful.start(make(live), sink, checkpoint, mode, state_parts).awaitTermination()
    until_end(spark, folder)
    until_end(spark, checkpoint)


def _store(spark):
    path = scratch(spark, "stream-out")
    spark.createDataFrame([], "none int").write.parquet(f"{path}/none")
    until_end(spark, path)
    return path


def stream_provider_threads(spark, sf):
    """Thread counts by engine, provider and model from outcomes in event time; the stream is stopped halfway and goes on."""
    log, out = job_queries._provider_log(spark, sf), _store(spark)
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    closing = log.limit(1).select(F.lit("plain").alias("engine"), F.lit("openai").alias("provider"), F.lit("none").alias("model"), F.lit("2200-01-01").cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("string").alias("outcome"))
    make = lambda live: stateful.thread_counts(live.withColumn("floor", control.thread_floor(F.col("engine"), F.col("provider"))))
    _runs(spark, [log.where(half), log.where(~half), closing], make, stateful.log_sink(f"{out}/log"), "update", min(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # keys are few
    log = stateful.read_log(spark, f"{out}/log", stateful.THREADS)
    last = log.groupBy("engine", "provider", "model").agg(F.max_by(F.struct("threads", "streak", "observations"), "observations").alias("s"))
    return last.select("engine", "provider", "model", "s.*")


def stream_cost_cap(spark, sf):
    e, out = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("seq"), F.col("value").alias("cost")), _store(spark)
    middle = e.agg((F.max("seq") / 2).cast("long")).first()[0] or 0
    _runs(spark, [e.where(F.col("seq") <= middle), e.where(F.col("seq") > middle)], lambda live: live, stateful.cost_cap_sink(out, 500.0), "append")
    runs = stateful.read_log(spark, f"{out}/runs", stateful.RUNS).where("runs")
    return runs.groupBy(F.col("job").cast("long").alias("user_id")).agg(F.count("*").alias("runs"), F.max("seq").alias("last"))


def stream_progress(spark, sf):
    """Progress of each job, from chunks that come twice and more, by way of two sinks; stopped halfway. Some jobs have no total."""
    chunk = F.col("event_id") % 64
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), chunk.alias("chunk"), F.when(F.col("user_id") % 5 > 0, F.lit(64)).otherwise(F.lit(0)).alias("total"), (F.col("event_id") % 3 == 0).alias("first"))
    out = _store(spark)
    newest = lambda batch, number: stateful.log_sink(f"{out}/newest")(batch.groupBy("job_id").agg(F.max_by("progress", "done").alias("progress"), F.max("done").alias("done")), number)
    _runs(spark, [e.where("first").drop("first"), e.where("not first").drop("first")], stateful.progress, stateful.by_batch(stateful.log_sink(f"{out}/log"), newest), "append")
    log = stateful.read_log(spark, f"{out}/log", stateful.PROGRESS).groupBy("job_id").agg(F.count("*").alias("events"), F.max("done").alias("done"))
    last = stateful.read_log(spark, f"{out}/newest", "job_id long, progress double, done long").groupBy("job_id").agg(F.max_by("progress", "done").alias("progress"))
    return log.join(last, "job_id")


def stream_term_refresh(spark, sf):
    """Terms of each book's latest run, and decisions, in a store; runs of odd days come first."""
    e, store = table(spark, sf, "events"), _store(spark)
    found = e.groupBy(F.col("user_id").cast("string").alias("book"), F.day("ts").cast("long").alias("run"), F.col("event_type").alias("term")).agg(F.count("*").alias("n"))
    decided = e.where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("book"), F.lit("error").alias("term"), F.lit("dismissed").alias("status"), F.lit(0).alias("n")).distinct()
    stateful.decide(decided, store, 0)
    _runs(spark, [found.where("run % 2 = 1"), found.where("run % 2 = 0")], lambda live: live, stateful.refresh_sink(store), "append")
    return stateful.current_terms(spark, store)


def stream_windows(spark, sf):
    """An extension: events of each type in five-minute windows, with a watermark; the open windows at the end are not given."""
    e = state.replay(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "10 minutes")
    w = e.groupBy(F.window("t", "5 minutes"), "event_type").agg(F.count("*").alias("n"))
    return state.drain(w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "append").drop("batch")


def progress_events(spark, sf):
    """Progress of each job after each chunk."""
    li = control.numbered(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "chunk")
    total = li.groupBy("l_orderkey").agg(F.count("*").alias("total"))
    return li.join(total, "l_orderkey").select(F.col("l_orderkey").alias("job_id"), "chunk", "total", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("chunk") / F.col("total"), 9)).alias("progress"))


def resume_chunks(spark, sf):
    """Chunks of the frozen plan that are still to do."""
    from quarry.operators import planning

    plan = planning.page_chunks(job_queries._jobs(spark, sf))
    done = plan.where("(job_id + chunk_index) % 3 = 0").select("job_id", "chunk_index")
    return plan.join(done, ["job_id", "chunk_index"], "left_anti").groupBy("job_id").agg(F.count("*").alias("left"), F.min("chunk_index").alias("next"))


QUERIES = {f.__name__: f for f in (stream_aimd_threads, stream_provider_threads, stream_cost_cap, stream_progress, stream_term_refresh, stream_windows, progress_events, resume_chunks)}
SQL = {
    "stream_aimd_threads": job_queries.SQL["aimd_threads"],
    "stream_cost_cap": """SELECT user_id, count(*) AS runs, max(event_id) AS last FROM (SELECT *, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events)
      WHERE b <= 500 GROUP BY user_id""",
    "stream_provider_threads": job_queries.SQL["provider_threads"],
    "stream_progress": """SELECT user_id AS job_id, count(DISTINCT event_id % 64) AS events, count(DISTINCT event_id % 64) AS done, CASE WHEN user_id % 5 > 0 THEN count(DISTINCT event_id % 64) / 64 ELSE 0 END AS progress FROM events GROUP BY user_id""",
    "stream_term_refresh": """WITH f AS (SELECT user_id, day(ts) AS run, event_type AS term, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0)
      SELECT user_id::VARCHAR AS book, term, 'pending' AS status, n FROM f WHERE run = (SELECT max(run) FROM f g WHERE g.user_id = f.user_id) AND NOT (term = 'error' AND user_id % 3 = 0)
      UNION ALL SELECT user_id::VARCHAR, 'error', 'dismissed', 0 FROM d""",
    "progress_events": """SELECT job_id, chunk, total, round(chunk / total, 9) AS progress FROM (SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS chunk,
      count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)""",
    "resume_chunks": f"SELECT job_id, count(*) AS left, min(chunk_index) AS next FROM {job_queries._CHUNKS} WHERE (job_id + chunk_index) % 3 <> 0 GROUP BY job_id",
}
