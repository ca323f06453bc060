"""Stateful streams: thread counts, running cost caps, refreshed terms. Each has a batch twin in ``quarry.operators``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.operators.control import next_threads
from quarry.sources.shared import scratch


def _threads(floor: int, start: int):
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        threads, streak, seen = state.get if state.exists else (start, 0, 0)
        log = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for found in log.outcome:
            seen += 1
            streak = streak + 1 if found == "success" else 0
            threads = next_threads(threads, found, floor)
        state.update((threads, streak, seen))
        yield pd.DataFrame({"key": [key[0]], "threads": [threads], "streak": [streak], "observations": [seen]})

    return step


def thread_counts(outcomes: DataFrame, floor: int = 8, start: int = 8) -> DataFrame:
    """A stream (key, ts, event_id, outcome) to updates of each key's thread count; order within a batch is by time."""
    out = "key long, threads int, streak int, observations int"
    return outcomes.groupBy("key").applyInPandasWithState(_threads(floor, start), out, "threads int, streak int, seen int", "update", GroupStateTimeout.NoTimeout)


def _capped(cap: float):
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (spent,) = state.get if state.exists else (0.0,)
        log = pd.concat(list(frames)).sort_values(["seq"])
        before = []
        for cost in log.cost.fillna(0.0):
            before.append(spent)
            spent += cost if spent <= cap else 0.0
        state.update((spent,))
        yield pd.DataFrame({"key": key[0], "seq": log.seq, "runs": [b <= cap for b in before]})

    return step


def cost_cap(costs: DataFrame, cap: float) -> DataFrame:
    """A stream (key, seq, cost) to whether each chunk still runs: those before it cost at most ``cap`` together."""
    return costs.groupBy("key").applyInPandasWithState(_capped(cap), "key long, seq long, runs boolean", "spent double", "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table of a data folder as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote, with the number of the batch."""
    spark = stream.sparkSession
    out = scratch(spark, "stream-out")
    write = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "stream-state")).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    fields = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(fields).parquet(out) if query.lastProgress else spark.createDataFrame([], fields)


def refresh_terms(known: DataFrame, found: DataFrame) -> DataFrame:
    """Stored terms (book, term, status, n) after a new run: decided ones stay, pending ones give way to what was found now."""
    decided = known.where("status != 'pending'")
    fresh = found.join(decided, ["book", "term"], "left_anti").select("book", "term", F.lit("pending").alias("status"), "n")
    return decided.select("book", "term", "status", "n").unionByName(fresh)
