"""Requests for jobs: the gate, duplicates, and what earlier requests of the same batch have done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.control import latest_before, spent_before
from quarry.sources.shared import written

JOB_TYPES = ("translate", "parse_only")


def gate(requests: DataFrame, cap: float) -> DataFrame:
    """``requests`` with the reason for which they are refused (``refused``; null if they aren't): no such upload, an unknown job type, DeepL
    for a PDF, or an estimate above ``cap`` that nobody confirmed. The first reason counts; a job without translation has no cost."""
    translates = F.col("job_type") == "translate"
    why = (
        F.when(F.col("file_hash").isNull(), "not_found").when(F.col("job_type").isNull() | ~F.col("job_type").isin(*JOB_TYPES), "job_type")
        .when(translates & (F.col("provider") == "deepl") & F.col("file_type").startswith("pdf"), "provider")
        .when(translates & (F.col("cost") > cap) & ~F.coalesce("confirm", F.lit(False)), "cost")
    )
    return requests.withColumn("refused", why)


#: Order of a file's timeline: at one time completions come first, but for that of a job made at that very time, which comes after its request.
_ORDER = ["at", "turn", "kind"]


def _timeline(done: DataFrame, asked: DataFrame) -> DataFrame:
    """Completions (kind 1, with the job they complete) and requests (kind 0) of each file."""
    asking = asked.select("file_hash", "at", F.col("request_id").alias("turn"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("job"))
    return done.select("file_hash", "at", "turn", F.lit(1).alias("kind"), "job").unionByName(asking)


def _completions(rows: DataFrame, job: Column, turn: Column) -> DataFrame:
    return rows.where("completed_at is not null").select("file_hash", F.col("completed_at").alias("at"), turn.cast("long").alias("turn"), job.cast("string").alias("job"))


def create_jobs(requests: DataFrame, jobs: DataFrame, cap: float = 2.0) -> DataFrame:
    """``requests`` (request_id, at, file_hash, file_type, job_type, provider, cost, confirm, force, completed_at) to (request_id, result, reason, job).

    ``jobs``: (job_id, file_hash, job_type, completed_at) that exist; completed_at is null unless they completed, and of a request says when its job
    would. result: rejected (with the reason), duplicate (job: the one that completed last for the same file), or created
    (job: ``r`` and the request's id). A translation without ``force`` is a duplicate if another one of its file has completed by then:
    one that exists, or one that an earlier request of the batch made. Requests and completions of a file are gone through in order of time in
    ranges, so a file that everybody asks for lies in many tasks. A request that is a duplicate makes no job; that an earlier one did
    complete is already known from the one it repeats, so one pass tells which requests make jobs, and a second which job each duplicate repeats."""
    checked = written(gate(requests, cap), "requests")
    asked = checked.where("refused is null and job_type = 'translate'")
    own = F.concat(F.lit("r"), F.col("request_id").cast("string"))
    turn = F.when(F.col("completed_at") == F.col("at"), F.col("request_id"))
    existing = _completions(jobs.where("job_type = 'translate'"), F.col("job_id"), F.lit(None))
    could = existing.unionByName(_completions(asked.where("completed_at >= at"), own, turn))
    counted = spent_before(_timeline(could, asked), ["file_hash"], _ORDER, "kind")
    again = counted.where("kind = 0").select(F.col("turn").alias("request_id"), (F.col("spent_before") > 0).alias("again"))
    known = written(checked.join(again, "request_id", "left").withColumn("again", F.coalesce("again", F.lit(False)) & ~F.coalesce("force", F.lit(False))), "requests")
    made = _completions(known.where("refused is null and job_type = 'translate' and not again and completed_at >= at"), own, turn)
    events = _timeline(existing.unionByName(made), known.where("again"))
    last = latest_before(events, ["file_hash"], _ORDER, F.when(F.col("kind") == 1, F.struct("at", "job")), "last")
    repeats = last.where("kind = 0").select(F.col("turn").alias("request_id"), F.col("last.job").alias("repeats"))
    result = F.when(F.col("refused").isNotNull(), "rejected").when(F.col("again"), "duplicate").otherwise("created")
    job = F.when(result == "created", own).when(result == "duplicate", F.col("repeats"))
    return known.join(repeats, "request_id", "left").select("request_id", result.alias("result"), F.col("refused").alias("reason"), job.alias("job"))
