"""Job control: outcomes, thread counts, roll-ups, recovery, history."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lexicon as L
from quarry.sources.shared import written


def outcome(exit_code: Column, rate_limit_hits: Column, duration: Column, timeout: Column) -> Column:
    """Class of a finished chunk; a null exit code is a timeout, and comes first."""
    return (
        F.when(exit_code.isNull(), F.when(rate_limit_hits >= 1, "timeout_signalled").otherwise("timeout_silent"))
        .when(rate_limit_hits >= 1, "rate_limited")
        .when(exit_code != 0, "error")
        .when(duration <= 0.75 * timeout, "success")
        .otherwise("slow_success")
    )


def thread_floor(engine: Column, provider: Column) -> Column:
    """Least thread count of an engine and provider; null where none is known."""
    return reduce(lambda found, x: found.when((engine == x[0]) & (provider == x[1]), x[2]), L.THREAD_FLOORS, F.when(F.lit(False), 0))


def next_threads(threads: int, found: str, floor: int) -> int:
    """Two more after success, half (at least the floor) after overload, else as many; never above the ceiling."""
    if found in ("rate_limited", "timeout_signalled"):
        return max(floor, threads // 2)
    return min(L.THREAD_CEILING, threads + 2 * (found == "success"))


def _shortened(keys: list[str]):
    """A sorted partition to one row a key: what its part of the log does to any thread count, and to the run of successes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        key, leads, tail, clean, n = None, [], 0, True, 0
        done = []
        names = [*keys, "floor", "part", "leads", "tail", "clean", "n"]
        for frame in frames:
            for *k, floor, found in frame[[*keys, "floor", "outcome"]].itertuples(index=False, name=None):
                if [*k, floor] != key:
                    if n:
                        done.append((*key, part, leads, tail, clean, n))
                    key, leads, tail, clean, n = [*k, floor], list(range(L.THREAD_CEILING + 1)), 0, True, 0
                low, high = next_threads(leads[0], found, floor), next_threads(leads[-1], found, floor)
                leads = [low] * len(leads) if low == high else [next_threads(t, found, floor) for t in leads]  # steps keep the order
                tail, clean, n = (tail + 1, clean, n + 1) if found == "success" else (0, False, n + 1)
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=names)
                done = []
        if n:
            done.append((*key, part, leads, tail, clean, n))
        yield pd.DataFrame(done, columns=names)

    return run


def thread_counts(log: DataFrame, key: str | list[str], order: list[str], floor: int | Column = 8) -> DataFrame:
    """``log`` (key columns, order columns, outcome) to the thread count and the run of successes at the end of each key's log.

    Every key begins at its ``floor``, which depends on nothing but the key, and never falls below it. A step maps thread counts to
    thread counts, and such maps combine; so ranges of the log are shortened to one map a key wherever they are, and a long
    log of one key is spread over many tasks. Rows with a null in the key, or without a floor, are left out."""
    keys = [key] if isinstance(key, str) else key
    kinds = ", ".join(f"`{k}` {log.schema[k].dataType.simpleString()}" for k in keys)
    least = F.lit(floor) if isinstance(floor, int) else floor
    known = log.select(*keys, *order, least.cast("int").alias("floor"), "outcome").where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in [*keys, "floor"])))
    ranges = known.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    short = ranges.select(*keys, "floor", "outcome").mapInPandas(_shortened(keys), f"{kinds}, floor int, part int, leads array<int>, tail int, clean boolean, n int")
    zero = F.struct(F.col("floor").alias("threads"), F.lit(0).alias("streak"), F.lit(0).alias("seen"))

    def step(s: Column, p: Column) -> Column:
        streak = F.when(p["clean"], s["streak"]).otherwise(0) + p["tail"]
        return F.struct(F.get(p["leads"], s["threads"]).alias("threads"), streak.alias("streak"), (s["seen"] + p["n"]).alias("seen"))

    parts = short.groupBy(*keys, "floor").agg(F.array_sort(F.collect_list(F.struct("part", "leads", "tail", "clean", "n"))).alias("p"))  # one a partition at most
    return parts.select(*keys, F.aggregate("p", zero, step).alias("s")).select(*keys, F.col("s.threads").alias("threads"), F.col("s.streak").alias("streak"), F.col("s.seen").alias("observations"))


def warm_chunk_size(observations: Column, streak: Column) -> Column:
    return F.when((observations >= 3) & (streak >= 3), 40).otherwise(20)


def cost_source(chunks: DataFrame, job: str, cost: str, source: str) -> DataFrame:
    """metered only if every chunk that has a cost is metered, and there is one."""
    has = F.col(cost).isNotNull()
    good = (F.count_if(has) > 0) & (F.count_if(has & ~F.col(source).eqNullSafe(F.lit("metered"))) == 0)
    return chunks.groupBy(job).agg(F.when(good, "metered").otherwise("estimated").alias("cost_source"), F.round(F.sum(F.coalesce(cost, F.lit(0.0))), 6).alias("actual_cost"))


def sweep_orphans(jobs: DataFrame) -> DataFrame:
    """After a restart: active jobs have failed, at their own finishing time if they have one; doing it again changes nothing."""
    active = F.col("status").isin(L.ACTIVE_STATES)
    return jobs.withColumn("finished_at", F.when(active, F.coalesce("finished_at", "now")).otherwise(F.col("finished_at"))).withColumn("status", F.when(active, "failed").otherwise(F.col("status"))).drop("now")


#: What may be uploaded, in lower case, and the most bytes of a file.
UPLOADS, UPLOAD_BYTES = (".pdf", ".epub"), 500 << 20


def upload_check(name: Column, n_bytes: Column) -> tuple[Column, Column]:
    """(stored name, result) of an upload: its name without folders, so it can't leave the upload folder, and ``ok`` or what it is
    refused for: no name, another extension, too many bytes."""
    base = F.regexp_extract(F.rtrim(name, F.lit("/")), "([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))
    result = F.when(F.coalesce(name, F.lit("")) == "", "no_name").when(~suffix.isin(*UPLOADS), "extension").when(n_bytes > UPLOAD_BYTES, "too_large").otherwise("ok")
    return base, result


def transitions(jobs: DataFrame) -> DataFrame:
    """``jobs`` (status, cancel_requested, request: retry, cancel or null; ...) after the request, with its result.

    A retry takes jobs that failed, were cancelled or ran into their cap, queues them, and withdraws an earlier cancellation. A
    cancellation takes jobs that have not ended, and only leaves a mark: the job stops after its chunk. Else nothing changes."""
    retry = (F.col("request") == "retry") & F.col("status").isin("failed", "cancelled", "cost_capped")
    cancel = (F.col("request") == "cancel") & ~F.col("status").isin("completed", "failed", "cancelled")
    out = jobs.withColumn("result", F.when(F.col("request").isNull(), "none").when(retry, "queued").when(cancel, "marked").otherwise("refused"))
    done = F.col("result")
    marked = F.when(done == "queued", False).when(done == "marked", True).otherwise(F.col("cancel_requested"))
    return out.withColumn("status", F.when(done == "queued", "queued").otherwise(F.col("status"))).withColumn("cancel_requested", marked)


def latest_duplicate(files: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """Each file that is not the latest with its digest, and the latest one."""
    newest = files.groupBy(digest).agg(F.max(F.struct(*order)).alias("top"), F.count("*").alias("copies")).where("copies > 1")
    return files.join(newest, digest).where(F.struct(*order) != F.col("top"))


def _reach(ranges: DataFrame, key: list[str], each: Column, gather) -> DataFrame:
    """What a key has in the ranges before each of those that it reaches into; at most one row a range."""
    counts = ranges.groupBy(*key, "_range").agg(gather(each).alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    reach = counts.withColumn("_before", gather("_n").over(earlier)).where("_before is not null")
    return reach.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(key)), F.col("_range").alias("_at"), "_before")


def _at_range(key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)), F.col("_range") == F.col("_at"))


def _by_ranges(df: DataFrame, key: list[str], order: list, each: Column, name: str, gather=F.sum, add=lambda here, before: here + F.coalesce(before, F.lit(0))) -> DataFrame:
    """``gather`` of ``each`` over a row and those of its key before it, in ``order`` (names or sort orders); null keys are one key.

    Rows are dealt to ranges of key and order, written, and gathered within each range; what a key has in earlier ranges is added (``add``).
    So a key that holds a third of all rows lies in many tasks. At most one key reaches into a range from the one before,
    hence at most one row a range is broadcast."""
    ranges = written(df.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "places")
    so_far = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranges.withColumn(name, gather(each).over(so_far)).join(F.broadcast(_reach(ranges, key, each, gather)), _at_range(key), "left")
    return placed.withColumn(name, add(F.col(name), F.col("_before"))).drop("_range", "_at", "_before", *(f"_key{i}" for i in range(len(key))))


def latest_before(df: DataFrame, key: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The greatest ``value`` of the rows of the key up to each row, itself included; nulls don't count; in ranges (``_by_ranges``)."""
    return _by_ranges(df, key, order, value, name, F.max, F.greatest)


def numbered(df: DataFrame, key: list[str], order: list, name: str = "pos") -> DataFrame:
    """Place of each row among those of its key, from 1, in ``order``, whose ties are broken in any way; in ranges (``_by_ranges``)."""
    return _by_ranges(df, key, order, F.lit(1).cast("long"), name)


def spent_before(df: DataFrame, key: list[str], order: list, cost: str, name: str = "spent_before") -> DataFrame:
    """What the rows of the key before each row cost together, exact to a millionth; a null cost is 0; in ranges (``_by_ranges``)."""
    exact = F.coalesce(F.col(cost), F.lit(0)).cast("decimal(26,6)")
    return _by_ranges(df, key, order, exact, name).withColumn(name, (F.col(name) - exact).cast("decimal(32,6)"))


def sums_before(df: DataFrame, key: list[str], order: list, cost: str, whole: int = 100_000) -> DataFrame:
    """``spent_before`` as SQL adds doubles: ``spent_before`` (exact to a millionth) and ``added_before``, the doubles added one by one in
    ``order``, which can miss the exact sum by its last digits; null costs are left out.

    A key of at most ``whole`` rows that lies in several ranges goes to the first of them, so its doubles are added in one task. One
    with more rows stays in its ranges; from the second on its ``added_before`` is the exact sum."""
    exact = F.coalesce(F.col(cost), F.lit(0)).cast("decimal(26,6)")
    ranges = written(df.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "places")
    counts = ranges.groupBy(*key, "_range").agg(F.count("*").alias("_n")).groupBy(*key).agg(F.sum("_n").alias("_n"), F.min("_range").alias("_home"), F.max("_range").alias("_last"))
    small = counts.where((F.col("_home") < F.col("_last")) & (F.col("_n") <= whole)).select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(key)), "_home", "_last")  # fewer than ranges
    lies = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)), F.col("_range").between(F.col("_home"), F.col("_last")))
    homed = ranges.join(F.broadcast(small), lies, "left").withColumn("_range", F.coalesce("_home", "_range")).select(*ranges.columns)
    before = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = homed.withColumns({"spent_before": F.coalesce(F.sum(exact).over(before), F.lit(0)), "added_before": F.coalesce(F.sum(F.col(cost).cast("double")).over(before), F.lit(0.0))})
    placed = placed.join(F.broadcast(_reach(homed, key, exact, F.sum)), _at_range(key), "left")
    sum_ = (F.col("spent_before") + F.coalesce("_before", F.lit(0))).cast("decimal(32,6)")
    return placed.withColumns({"spent_before": sum_, "added_before": F.when(F.col("_before").isNull(), F.col("added_before")).otherwise(sum_.cast("double"))}).drop("_range", "_at", "_before", *(f"_key{i}" for i in range(len(key))))
