"""Sessions whose events arrive late, in batches: every version of every session, and what retracts it.

After each batch, a user's events so far form sessions: neighbours at most ``gap`` apart share one. A session that holds an
event of the batch is a new version, and retracts the standing sessions that it contains. Snapshot expansion:

1. Events of one user, batch and second are one row (summed before the shuffle). What touches within a batch is a run: it lies
   whole in every later snapshot. Times are cut into chunks of ``CHUNK`` gaps, so a user who has a third of all rows lies in
   many tasks.
2. The islands of all events together bound what can ever meet: runs go to the later batches of their own island only.
3. A snapshot's older batches are a sum of blocks of 1, 2, 4, ... batches; runs that touch within a block are merged before
   the block is replicated to its snapshots. So a session that goes on for B batches costs B log B rows, not the square.
4. In each snapshot, gaps to what was reached so far and their cumulative sum give the sessions, and, over the older rows
   alone, the sessions that stood before. Sessions without a new event are left out.
5. A standing session was made by the last batch it holds, so (user, batch, start) joins it with its successor.

Defined cases: an event without user, time or batch takes no part; repeated rows count one by one; equal times share a
session; a null value counts as 0; an empty table gives no versions; other columns are ignored, whatever their names. No text
is read. What one task holds of a user grows with time in gaps and with batches, not with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import spool, tidied

#: Gaps in a chunk of time.
CHUNK = 64


def _islands(rows: DataFrame, keys: list[str], gap: int, name: str) -> DataFrame:
    """``rows`` (start_s, end_s, ...) with the number of their island among those of ``keys``."""
    order = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.withColumn("_begins", (F.col("start_s") - F.coalesce(reach, F.col("start_s")) > gap).cast("int"))
    return begins.withColumn(name, F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def _merged() -> list[Column]:
    return [F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("batch").alias("batch")]


def _floor_div(x: Column, by: int) -> Column:
    """Rounded down, without a detour over doubles."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def _runs(events: DataFrame, gap: int) -> DataFrame:
    """user, chunk, batch, start_s, end_s, n, total: stretches of one batch, cut at the borders of chunks."""
    own = events.where(F.col("user").isNotNull() & F.col("at").isNotNull() & F.col("batch").isNotNull())
    points = own.groupBy("user", _floor_div(F.col("at"), CHUNK * gap).alias("chunk"), "batch", "at").agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("total"))
    rows = points.withColumns({"start_s": F.col("at"), "end_s": F.col("at")})
    return _islands(rows, ["user", "chunk", "batch"], gap, "_run").groupBy("user", "chunk", "batch", "_run").agg(*_merged()[:4]).drop("_run")


def _placed(runs: DataFrame, gap: int) -> DataFrame:
    """Runs with their island and, in the island, the place of their batch (from 0) and the number of batches."""
    pieces = spool(_islands(runs, ["user", "chunk"], gap, "_piece"), "session-pieces")
    spans = pieces.groupBy("user", "chunk", "_piece").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    islands = _islands(spans, ["user"], gap, "island").select("user", "chunk", "_piece", "island")
    placed = spool(pieces.join(islands, ["user", "chunk", "_piece"]).drop("chunk", "_piece"), "session-runs")
    of = Window.partitionBy("user", "island")
    batches = placed.select("user", "island", "batch").distinct()
    batches = batches.withColumn("i", F.row_number().over(of.orderBy("batch")) - 1).withColumn("n_batches", F.count("*").over(of).cast("int"))
    return spool(placed.join(batches, ["user", "island", "batch"]), "session-placed")


def _snapshots(placed: DataFrame, gap: int) -> DataFrame:
    """A snapshot's new runs, and the merged runs of the blocks of batches before it."""
    levels = F.expr("filter(sequence(0, 30), l -> ((i >> l) & 1) = 0 AND (((i >> l) + 1L) << l) < n_batches)")
    blocks = placed.withColumn("level", F.explode(levels)).withColumn("block", F.expr("i >> level"))
    keys = ["user", "island", "level", "block"]
    merged = _islands(blocks, keys, gap, "_run").groupBy(*keys, "n_batches", "_run").agg(*_merged())
    later = F.expr("sequence((block + 1) << level, cast(least((block + 2L) << level, n_batches) AS int) - 1)")
    columns = ["user", "island", "start_s", "end_s", "n", "total", "batch"]
    old = merged.select(*columns, F.explode(later).alias("snapshot"), F.lit(False).alias("new"))
    return placed.select(*columns, F.col("i").alias("snapshot"), F.lit(True).alias("new")).unionByName(old)


def _sessions(snapshots: DataFrame, gap: int) -> DataFrame:
    """Sessions with new events: one row for their new events, and one for each standing session in them (``standing``)."""
    keys = ["user", "island", "snapshot"]
    order = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    reach, old_reach = F.max("end_s").over(before), F.max(F.when(~F.col("new"), F.col("end_s"))).over(before)
    marked = snapshots.withColumns({
        "_begins": (F.col("start_s") - F.coalesce(reach, F.col("start_s")) > gap).cast("int"),
        "_stands": (~F.col("new") & (F.col("start_s") - F.coalesce(old_reach, F.col("start_s")) > gap)).cast("int"),
    })
    marked = marked.withColumns({"session": F.sum("_begins").over(so_far), "standing": F.when(~F.col("new"), F.sum("_stands").over(so_far))})
    parts = marked.groupBy(*keys, "session", "standing").agg(*_merged())
    whole, new = Window.partitionBy(*keys, "session"), F.col("standing").isNull()
    return parts.withColumns({
        "new_batch": F.max(F.when(new, F.col("batch"))).over(whole),
        "first_s": F.min("start_s").over(whole), "last_s": F.max("end_s").over(whole), "n_events": F.sum("n").over(whole), "value_sum": F.sum("total").over(whole),
        "n_new": F.sum(F.when(new, F.col("n"))).over(whole), "n_retracted": F.count("standing").over(whole),
    }).where("new_batch IS NOT NULL")


@tidied
def session_versions(events: DataFrame, user: str = "user", at: str = "at", batch: str = "batch", value: str = "value", gap: int = 420) -> DataFrame:
    """``events`` (user, time in seconds, batch, a value to be summed) to one row a version: user, batch, start_s, end_s, n_events,
    n_new (of its batch), n_retracted, value_sum, retracted_batch and retracted_start_s (the version that retracts it; null if none)."""
    own = events.select(F.col(user).alias("user"), F.col(at).cast("long").alias("at"), F.col(batch).cast("long").alias("batch"), F.col(value).cast("long").alias("value"))
    found = spool(_sessions(_snapshots(_placed(_runs(own, gap), gap), gap), gap), "session-parts")
    versions = found.where("standing IS NULL").select(
        "user", F.col("new_batch").alias("batch"), F.col("first_s").alias("start_s"), F.col("last_s").alias("end_s"), "n_events", "n_new", "n_retracted", "value_sum"
    )
    gone = found.where("standing IS NOT NULL").select("user", "batch", "start_s", F.col("new_batch").alias("retracted_batch"), F.col("first_s").alias("retracted_start_s"))
    return versions.join(gone, ["user", "batch", "start_s"], "left")


def turn_events(conversations: DataFrame) -> DataFrame:
    """The turns of conversations as events with made-up users, times and batches, by crc32 of their numbers."""
    own = conversations.where(F.col("turn").isNotNull() & F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("id"), F.col("turn").cast("long").alias("turn"))
    c, h = F.crc32(F.col("id").cast("string").cast("binary")), F.crc32(F.concat_ws(":", F.col("id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    at = F.shiftright(c, 1) % 7200 + 300 * F.col("turn") + h % 600
    g = _floor_div(h, 600)
    own = own.select((2 * F.shiftright("id", 3) + c % 2).alias("user"), at.alias("at"), h.alias("value"), F.when(g % 3 == 0, g % 4).otherwise(0).alias("late"))
    return own.withColumn("batch", _floor_div(F.col("at"), 3600) + F.col("late"))


def op11_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_versions(turn_events(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("value_sum", "h_sum")


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII string in DuckDB, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({steps}, lambda r, x: xor(xor(r, x) >> 1, 3988292384 * (xor(r, x) & 1)), 4294967295::BIGINT), 4294967295)"


SQL = f"""
WITH hashed AS (
  SELECT conv_id, turn, {crc32_sql("conv_id::VARCHAR")} AS c, {crc32_sql("conv_id::VARCHAR || ':' || turn::VARCHAR")} AS h
  FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
timed AS (
  SELECT 2 * floor(conv_id / 8)::BIGINT + c % 2 AS "user", floor(c / 2)::BIGINT % 7200 + 300 * turn + h % 600 AS s, h, floor(h / 600)::BIGINT AS g FROM hashed),
events AS (SELECT "user", s, h, floor(s / 3600)::BIGINT + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS batch FROM timed),
snapshots AS (SELECT DISTINCT "user" AS u, batch AS b FROM events),
seen AS (
  SELECT u, b, s, h, batch = b AS new, CASE WHEN s - lag(s) OVER (PARTITION BY u, b ORDER BY s) > 420 THEN 1 ELSE 0 END AS begins
  FROM snapshots JOIN events ON u = "user" AND batch <= b),
dealt AS (SELECT *, sum(begins) OVER (PARTITION BY u, b ORDER BY s ROWS UNBOUNDED PRECEDING) AS session FROM seen),
versions AS (
  SELECT u, b, min(s) AS s0, max(s) AS s1, count(*) AS n, count(*) FILTER (WHERE new) AS n_new, sum(h)::BIGINT AS h_sum
  FROM dealt GROUP BY u, b, session HAVING count(*) FILTER (WHERE new) > 0),
next AS (
  SELECT v.u, v.b, v.s0, min(w.b) AS rb, arg_min(w.s0, w.b) AS rs
  FROM versions v JOIN versions w ON w.u = v.u AND w.b > v.b AND v.s0 BETWEEN w.s0 AND w.s1 GROUP BY ALL),
gone AS (SELECT u, rb, rs, count(*) AS k FROM next GROUP BY ALL)
SELECT v.u AS "user", v.b AS batch, v.s0 AS start_s, v.s1 AS end_s, v.n AS n_events, v.n_new, coalesce(k, 0) AS n_retracted, v.h_sum,
       next.rb AS retracted_batch, next.rs AS retracted_start_s
FROM versions v LEFT JOIN next ON next.u = v.u AND next.b = v.b AND next.s0 = v.s0
LEFT JOIN gone ON gone.u = v.u AND gone.rb = v.b AND gone.rs = v.s0
"""
