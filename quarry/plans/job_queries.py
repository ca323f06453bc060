"""Queries on plans, costs, control and history. Orders stand for jobs, line items for chunks, events for outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon as L
from quarry.operators import control, planning, requests
from quarry.sources.shared import written
from quarry.sources.tables import table

ENGINES, PROVIDERS = ["plain", "layout"], ["deepseek", "openai", "gemini", "claude", "ollama"]
STATES = ["completed", "failed", "cancelled", "cost_capped", *L.ACTIVE_STATES]


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.get(F.array(*map(F.lit, STATES)), (F.col("o_orderkey") % len(STATES)).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("batch_id"), status.alias("status"), (F.col("o_custkey") % 400).alias("total_pages"),
        (F.col("o_totalprice") * 100).cast("long").alias("file_bytes"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("cost"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_custkey)")).alias("finished_at"),
    )


_JOBS = f"""(SELECT o_orderkey AS job_id, o_custkey AS batch_id, [{", ".join(f"'{s}'" for s in STATES)}][o_orderkey % {len(STATES)} + 1] AS status, o_custkey % 400 AS total_pages,
  trunc(o_totalprice * 100)::BIGINT AS file_bytes, o_orderdate AS created_at, o_totalprice AS cost,
  CASE WHEN o_custkey % 2 = 0 THEN o_orderdate + to_seconds(o_custkey) END AS finished_at FROM orders)"""


def page_chunk_plan(spark, sf):
    return planning.page_chunks(_jobs(spark, sf))


def chunk_survivors(spark, sf):
    return planning.survivors(planning.page_chunks(_jobs(spark, sf)))


_CHUNKS = f"""(SELECT job_id, chunk_index::INT AS chunk_index, page_start::INT AS page_start, page_end::INT AS page_end,
    CASE WHEN chunk_index > 0 THEN page_start END::INT AS overlap_start, CASE WHEN chunk_index > 0 THEN least(page_start + 1, page_end) END::INT AS overlap_end
  FROM (SELECT job_id, k AS chunk_index, CASE WHEN k = 0 THEN 1 ELSE k * 40 - 1 END AS page_start, CASE WHEN one THEN total_pages ELSE least((k + 1) * 40, total_pages) END AS page_end
    FROM (SELECT *, unnest(range(CASE WHEN one THEN 1 ELSE ceil(total_pages / 40)::BIGINT END)) AS k FROM (
      SELECT *, total_pages <= 50 AND file_bytes <= 20 * 1024 * 1024 AS one FROM {_JOBS} WHERE total_pages > 0))))"""


def _units(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("source").alias("book"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("book", "doc_id", "line", F.length("t").alias("n"), (F.trim("t") == "").alias("blank"))


def unit_chunk_plan(spark, sf):
    return planning.pack_units(_units(spark, sf).drop("blank"), ["doc_id", "line"])


_UNITS = """(SELECT source AS book, doc_id, (line - 1)::INT AS line, length(t) AS n, trim(t) = '' AS blank FROM (
  SELECT source, doc_id, generate_subscripts(t, 1) AS line, unnest(t) AS t FROM (SELECT source, doc_id, string_split(text, chr(10)) AS t FROM documents)))"""


def _pack(units: str) -> str:
    return f"""
WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY doc_id, line) AS rn FROM {units}),
bad AS (SELECT book, max(n) > 10000 AS bad FROM u GROUP BY book),
r AS (
  SELECT book, rn, doc_id, line, 0 AS chunk_index, 0 AS request_index, n AS run, n AS chars, 1 AS cnt FROM u WHERE rn = 1
  UNION ALL
  SELECT u.book, u.rn, u.doc_id, u.line, CASE WHEN r.run >= 8000 THEN r.chunk_index + 1 ELSE r.chunk_index END,
    CASE WHEN r.run >= 8000 THEN 0 WHEN r.chars + u.n > 1100 OR r.cnt >= 6 THEN r.request_index + 1 ELSE r.request_index END,
    CASE WHEN r.run >= 8000 THEN u.n ELSE r.run + u.n END,
    CASE WHEN r.run >= 8000 OR r.chars + u.n > 1100 OR r.cnt >= 6 THEN u.n ELSE r.chars + u.n END,
    CASE WHEN r.run >= 8000 OR r.chars + u.n > 1100 OR r.cnt >= 6 THEN 1 ELSE r.cnt + 1 END
  FROM r JOIN u ON u.book = r.book AND u.rn = r.rn + 1)
SELECT book, doc_id, line, CASE WHEN bad THEN NULL ELSE chunk_index END AS chunk_index, CASE WHEN bad THEN NULL ELSE request_index END AS request_index FROM r JOIN bad USING (book)"""


def _estimates(spark, sf):
    text = F.col("text")
    segs = F.greatest(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")), F.lit(1))
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.length(text).alias("chars"), segs.alias("segments"))
    return d.select("doc_id", "source", "lang", "chars", "segments", planning.input_tokens(F.col("chars"), F.col("segments"), F.col("lang"), 1314).alias("tokens_in"), planning.output_tokens(F.col("chars")).alias("tokens_out"))


_EST = """(SELECT doc_id, source, lang, chars, segments, trunc(chars / CASE WHEN lang = 'fr' THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END + segments * 1314 / CASE WHEN lang = 'fr' THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END)::BIGINT AS tokens_in,
  trunc(chars * 1.16::DOUBLE / 2.0::DOUBLE)::BIGINT AS tokens_out
  FROM (SELECT *, length(text) AS chars, greatest(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')), 1) AS segments FROM documents))"""


def job_cost_estimate(spark, sf):
    return _estimates(spark, sf)


def chunk_cost_estimate(spark, sf):
    """Every document as a chunk that was rendered: tokens and cost at one price."""
    e = _estimates(spark, sf).withColumn("tokens_out", planning.chunk_output_tokens(F.col("chars"))).withColumn("provider", F.lit("gemini")).withColumn("model", F.lit("gemini-2.5-pro"))
    return planning.priced(e).select("doc_id", "tokens_in", "tokens_out", F.round("cost_usd", 9).alias("cost_usd"))


def epub_cost_estimate(spark, sf):
    """Every source as an EPUB: the lines of its documents that aren't blank are units; the plan's requests are its segments. A book that can't be planned has no tokens."""
    units = written(_units(spark, sf).where("not blank").drop("blank"), "units")
    requests = planning.pack_units(units, ["doc_id", "line"]).where("request_index is not null").select("book", "chunk_index", "request_index").distinct().groupBy("book").agg(F.count("*").alias("requests"))
    book = units.groupBy("book").agg(F.sum("n").alias("total"), F.count("*").alias("units"))
    chars = planning.epub_inputs(F.col("total"), F.col("units"))
    return book.join(requests.withColumnRenamed("book", "b"), F.col("book").eqNullSafe(F.col("b")), "left").select(
        F.col("book").alias("source"), "units", "requests", chars.alias("chars"), planning.input_tokens(chars, F.col("requests"), F.lit("en"), 1314).alias("tokens_in"), planning.output_tokens(chars).alias("tokens_out")
    )


def checks_by_prefix(spark, sf):
    """Jobs' checks whose name matches a prefix pattern, in which an underscore stands for any character."""
    name = F.concat(F.get(F.array(*map(F.lit, ["babeldoc_", "babeldocs", "layout_", "babeldoc"])), (F.col("o_orderkey") % 4).cast("int")), F.col("o_custkey").cast("string"))
    checks = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), name.alias("name"))
    return checks.where(F.col("name").like("babeldoc_%")).groupBy("status").agg(F.count("*").alias("checks"), F.min("name").alias("first_name"))


def write_once(spark, sf):
    """Decisions that a retry replays: what a job has stays, what is missing is computed."""
    o = table(spark, sf, "orders")
    known = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_custkey") % 2 == 0, "en").otherwise("fr"))
    computed = F.when(F.col("o_totalprice") > 100_000, "fr").otherwise("en")
    size = F.when(F.col("o_orderkey") % 5 == 0, F.lit(25))
    return o.select("o_orderkey", F.coalesce(known, computed).alias("lang"), F.coalesce(size, F.when(F.col("o_custkey") % 2 == 0, F.lit(50)).otherwise(F.lit(10))).cast("int").alias("chunk_size"))


def _by_provider(spark, sf):
    e = _estimates(spark, sf)
    offers = [(p, m) for p, m, *_ in L.PRICES if m] + [("openai", "unheard-of"), ("deepl", ""), ("ollama", "any")]
    return planning.priced(e.withColumn("o", F.explode(F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")) for p, m in offers)))).select("doc_id", "source", "tokens_in", "tokens_out", "o.*"))


def cost_by_provider(spark, sf):
    return _by_provider(spark, sf).groupBy("provider", "model").agg(F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


_OFFERS = ", ".join(f"('{p}', '{m}', {a}::DOUBLE, {b}::DOUBLE)" for p, m, a, b in [x for x in L.PRICES if x[1]] + [("openai", "unheard-of", 2.5, 10.0), ("ollama", "any", 0.0, 0.0)])


def cost_gate(spark, sf):
    e = planning.priced(_estimates(spark, sf).withColumn("provider", F.lit("openai")).withColumn("model", F.lit("gpt-4o")))
    c = F.round("cost_usd", 9)
    return e.select("doc_id", c.alias("cost_usd"), F.round(F.col("cost_usd") * 2, 9).alias("high_usd"), (c > 0.02).alias("rejected"))


def batch_cost_gate(spark, sf):
    e = planning.priced(_estimates(spark, sf).withColumn("provider", F.lit("claude")).withColumn("model", F.lit("")))
    total = F.round(F.sum("cost_usd"), 6)
    return e.groupBy("source").agg(total.alias("cost_usd"), (total > 1.0).alias("rejected"))


def runaway_output(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"), F.pmod(F.col("doc_id") * 37, F.lit(6000)).alias("answer_tokens"))
    return d.select("doc_id", "answer_tokens", planning.output_tokens(F.col("chars")).alias("expected"), planning.runaway(F.col("chars"), F.col("answer_tokens")).alias("runaway"))


def _outcomes(spark, sf):
    e = table(spark, sf, "events")
    code = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") != "signup", 0)
    return e.select("event_id", "user_id", "ts", control.outcome(code, F.when(F.col("event_id") % 7 == 0, 1).otherwise(0), F.col("value"), F.lit(20.0)).alias("outcome"))


_OUT = """(SELECT event_id, user_id, ts, CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'timeout_signalled' ELSE 'timeout_silent' END WHEN event_id % 7 = 0 THEN 'rate_limited'
  WHEN event_type = 'error' THEN 'error' WHEN value <= 0.75 * 20.0 THEN 'success' ELSE 'slow_success' END AS outcome FROM events)"""


def chunk_outcome(spark, sf):
    return _outcomes(spark, sf).select("event_id", "outcome")


def aimd_threads(spark, sf):
    return control.thread_counts(_outcomes(spark, sf), "user_id", ["ts", "event_id"])


def _provider_log(spark, sf):
    """Outcomes by (engine, provider, model); some providers have no floor."""
    pick = lambda names, c: F.get(F.array(*map(F.lit, names)), c.cast("int"))
    u = F.col("user_id")
    engine, provider = pick(ENGINES, u % 2), pick(PROVIDERS, F.floor(u / 2) % 5)
    return _outcomes(spark, sf).select(engine.alias("engine"), provider.alias("provider"), F.concat(F.lit("m"), (F.floor(u / 10) % 7).cast("string")).alias("model"), "ts", "event_id", "outcome")


def provider_threads(spark, sf):
    """Thread counts by engine, provider and model, from the floor of engine and provider on."""
    return control.thread_counts(_provider_log(spark, sf), ["engine", "provider", "model"], ["ts", "event_id"], control.thread_floor(F.col("engine"), F.col("provider")))


def warm_chunk_size(spark, sf):
    t = control.thread_counts(_outcomes(spark, sf), "user_id", ["ts", "event_id"])
    return t.select("user_id", control.warm_chunk_size(F.col("observations"), F.col("streak")).alias("chunk_size"))


_AIMD = f"""(SELECT user_id, list_reduce(list_concat([{{'threads': 8, 'streak': 0, 'seen': 0}}], list_transform(list(outcome ORDER BY ts, event_id),
    lambda o: {{'threads': CASE o WHEN 'success' THEN 2 WHEN 'rate_limited' THEN -1 WHEN 'timeout_signalled' THEN -1 ELSE 0 END, 'streak': CASE o WHEN 'success' THEN 1 ELSE 0 END, 'seen': 1}})),
    lambda s, e: {{'threads': CASE WHEN e.threads < 0 THEN greatest(8, s.threads // 2) ELSE least(32, s.threads + e.threads) END, 'streak': CASE WHEN e.streak = 1 THEN s.streak + 1 ELSE 0 END, 'seen': s.seen + 1}}) AS s FROM {_OUT} GROUP BY user_id)"""


_LOG = f"""(SELECT {ENGINES}[user_id % 2 + 1] AS engine, {PROVIDERS}[(user_id // 2) % 5 + 1] AS provider, 'm' || (user_id // 10) % 7 AS model, ts, event_id, outcome FROM {_OUT})"""
_FLOOR = "CASE provider WHEN 'gemini' THEN 4 ELSE 8 END // CASE engine WHEN 'layout' THEN 2 ELSE 1 END"
_PROVIDER_AIMD = f"""
WITH RECURSIVE o AS (SELECT *, {_FLOOR} AS floor, row_number() OVER (PARTITION BY engine, provider, model ORDER BY ts, event_id) AS rn FROM {_LOG} WHERE provider <> 'ollama'),
f AS (
  SELECT engine, provider, model, floor, 0::BIGINT AS rn, floor AS threads, 0 AS streak FROM (SELECT DISTINCT engine, provider, model, floor FROM o)
  UNION ALL
  SELECT o.engine, o.provider, o.model, o.floor, o.rn, CASE WHEN outcome IN ('rate_limited', 'timeout_signalled') THEN greatest(o.floor, threads // 2) WHEN outcome = 'success' THEN least(32, threads + 2) ELSE threads END,
    CASE WHEN outcome = 'success' THEN streak + 1 ELSE 0 END
  FROM f JOIN o ON o.engine = f.engine AND o.provider = f.provider AND o.model = f.model AND o.rn = f.rn + 1)
SELECT engine, provider, model, arg_max(threads, rn) AS threads, arg_max(streak, rn) AS streak, max(rn) AS observations FROM f GROUP BY ALL"""


def running_cost_cap(spark, sf):
    kept = planning.running_cap(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_extendedprice", 100_000.0)
    return kept.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("chunks_run"), F.round(F.sum("l_extendedprice"), 2).alias("spent"), (F.round(F.sum("l_extendedprice"), 2) > 100_000).alias("cost_capped"))


def batch_cost_cap(spark, sf):
    """Jobs of a batch run shortest first; one is skipped when those before it cost more than the cap together."""
    placed = control.spent_before(_jobs(spark, sf).select("job_id", "batch_id", "total_pages", "file_bytes", "cost"), ["batch_id"], ["total_pages", "file_bytes", "job_id"], "cost")
    spent = F.round(F.col("spent_before").cast("double"), 2)
    return placed.select("job_id", "batch_id", spent.alias("spent_before"), (spent > 500_000).alias("skipped"))


def cost_source_rollup(spark, sf):
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_discount") > 0.01, F.col("l_extendedprice")).alias("cost"), F.when(F.col("l_returnflag") != "A", "metered").otherwise("estimated").alias("source"))
    return control.cost_source(chunks, "job_id", "cost", "source")


def batch_rollup(spark, sf):
    return _jobs(spark, sf).groupBy("batch_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def orphan_sweep(spark, sf):
    return control.sweep_orphans(_jobs(spark, sf).select("job_id", "status", "finished_at", F.lit("2024-06-01").cast("timestamp_ntz").alias("now")))


def job_history_page(spark, sf):
    """Third page of twenty, newest first; the limit is the feature."""
    return _jobs(spark, sf).where(F.col("status").isin("completed", "failed")).orderBy(F.desc("created_at"), "job_id").offset(40).limit(20).select("job_id", "status", "created_at")


def job_counts(spark, sf):
    return _jobs(spark, sf).groupBy("status").agg(F.count("*").alias("jobs"), F.count_if(F.col("total_pages") > 200).alias("long_jobs"))


def job_duration(spark, sf):
    j = _jobs(spark, sf)
    secs = F.unix_timestamp(F.col("finished_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return j.select("job_id", F.when(F.col("status").isin(L.TERMINAL_STATES), secs).alias("duration_seconds"), F.bround(F.col("total_pages") / 400 * 100, 1).alias("progress_percent"))


def status_guards(spark, sf):
    s = F.col("status")
    return _jobs(spark, sf).select("job_id", s.isin("failed", "cancelled", "cost_capped").alias("can_retry"), (~s.isin(L.ACTIVE_STATES)).alias("can_delete"), (~s.isin("completed", "failed", "cancelled")).alias("can_cancel"))


def latest_duplicate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return control.latest_duplicate(d, "digest", ["doc_id"]).select("doc_id", F.col("top.doc_id").alias("latest"), "copies")


def shortest_first(spark, sf):
    jobs = _jobs(spark, sf).select("batch_id", "job_id", F.coalesce(F.nullif("total_pages", F.lit(0)), "file_bytes").alias("size"))
    return control.numbered(jobs, ["batch_id"], ["size", "job_id"], "place").select("batch_id", "job_id", F.col("place").cast("int").alias("place"))


def bilingual_interleave(spark, sf):
    """Pages of two versions of each book side by side; the second may be shorter.

    A page's place follows from its position in its version and the number of pages of the other one."""
    d = table(spark, sf, "documents").where("lang in ('en', 'fr')").select(F.col("source").alias("book"), "doc_id", "lang")
    pages = d.groupBy("book").agg(F.count_if(F.col("lang") == "en").alias("firsts"), F.count_if(F.col("lang") == "fr").alias("seconds"))
    placed = control.numbered(d, ["book", "lang"], ["doc_id"]).join(pages, "book")
    is_first = F.col("lang") == "en"
    place = F.when(is_first, F.col("pos") + F.least(F.col("pos") - 1, F.col("seconds"))).otherwise(2 * F.col("pos"))
    return placed.where(is_first | (F.col("pos") <= F.col("firsts"))).select("book", "doc_id", place.alias("place"))


def file_router(spark, sf):
    """Books as files, documents as pages: digital if enough pages, of those that hold anything, hold text."""
    d = table(spark, sf, "documents").select(F.col("source").alias("file"), (F.col("n_chars") > 400).alias("has_text"), (F.col("doc_id") % 3 == 0).alias("has_image"))
    g = d.groupBy("file").agg(F.count("*").alias("n"), F.count_if("has_text").alias("texts"), F.count_if(~F.col("has_text") & F.col("has_image")).alias("images"))
    ratio = F.when(F.col("n") == F.col("images"), 0.0).otherwise(F.col("texts") / (F.col("n") - F.col("images")))
    return g.select("file", F.round(ratio, 9).alias("ratio"), F.when(ratio > 0.9, "pdf_digital").otherwise("pdf_scan").alias("file_type"))


def upload_hashes(spark, sf):
    t = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.sha2(t, 256).alias("sha256"), F.octet_length(t).alias("n_bytes"))


def _uploads(spark, sf):
    """Pages as uploads under names of several kinds, some of them of many megabytes."""
    kind = F.get(F.array(*map(F.lit, [".pdf", ".EPUB", ".txt", "", ".tar.Pdf", "/"])), (F.col("page_id") % 6).cast("int"))
    name = F.when(F.col("page_id") % 11 > 0, F.concat(F.lit("../up/book"), F.col("page_id").cast("string"), kind))
    return table(spark, sf, "pages").select("page_id", name.alias("name"), (F.octet_length("html") * (F.col("page_id") % 9) * 100_000).alias("n_bytes"))


def upload_checks(spark, sf):
    stored, result = control.upload_check(F.col("name"), F.col("n_bytes"))
    return _uploads(spark, sf).select("page_id", stored.alias("stored"), result.alias("result"))


def upload_delete(spark, sf):
    """Jobs after uploads were deleted: a job keeps its row, whether its file is still there or not."""
    files = _uploads(spark, sf).where("page_id % 4 > 0").select(F.col("page_id").alias("file_id"), F.lit(True).alias("there"))
    jobs = _jobs(spark, sf).select("job_id", F.col("batch_id").alias("file_id"))
    return jobs.join(files, "file_id", "left").select("job_id", "file_id", F.coalesce("there", F.lit(False)).alias("file_there"))


def job_transitions(spark, sf):
    request = F.get(F.array(*map(F.lit, ["retry", "cancel"])), (F.col("batch_id") % 3).cast("int"))
    jobs = _jobs(spark, sf).select("job_id", "status", (F.col("batch_id") % 2 == 0).alias("cancel_requested"), request.alias("request"))
    return control.transitions(jobs).drop("request")


def download_names(spark, sf):
    done = F.coalesce("finished_at", "created_at")
    return _jobs(spark, sf).select("job_id", F.concat(F.lit("book"), F.col("job_id").cast("string"), F.lit("_bilingual_"), F.date_format(done, "yyyyMMdd-HHmmss"), F.lit(".pdf")).alias("name"))


def _requests(spark, sf):
    """Orders as requests, customers as files that many ask for again; parts of the orders are jobs that exist."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    late = F.when(k % 4 > 0, F.col("o_orderdate") + F.expr("make_dt_interval(cast(o_orderkey % 90 AS int))"))
    kind = F.when(k % 17 == 0, "other").when(k % 6 == 0, "parse_only").otherwise("translate")
    rows = o.select(
        k.alias("request_id"), F.col("o_orderdate").alias("at"), F.when(k % 23 > 0, (F.floor(F.col("o_custkey") / 10)).cast("string")).alias("file_hash"), F.when(k % 3 == 0, "epub").otherwise("pdf_scan").alias("file_type"), kind.alias("job_type"),
        F.when(k % 7 == 0, "deepl").otherwise("openai").alias("provider"), (F.col("o_totalprice") / 100_000).alias("cost"), (k % 5 == 0).alias("confirm"), (k % 13 == 0).alias("force"), late.alias("completed_at"),
    )
    jobs = rows.where("request_id % 10 = 1").select(F.col("request_id").alias("job_id"), "file_hash", "job_type", "completed_at")
    return rows.where("request_id % 10 <> 1"), jobs


def job_requests(spark, sf):
    """One batch of requests for jobs: rejected, duplicate or created."""
    return requests.create_jobs(*_requests(spark, sf))


def effective_settings(spark, sf):
    base = spark.createDataFrame([("cap", "2.0"), ("enabled", "true"), ("threads", "8"), ("overlap", "2")], "key string, value string")
    own = spark.createDataFrame([("threads", "16"), ("enabled", "off"), ("other", "1")], "key string, value string").withColumnRenamed("value", "override")
    s = base.join(F.broadcast(own), "key", "left").select("key", F.coalesce("override", "value").alias("value"))
    return s.select("key", "value", F.when(F.col("key") == "enabled", F.lower("value").isin("1", "true", "yes", "on")).alias("flag"))


QUERIES = {f.__name__: f for f in (
    page_chunk_plan, chunk_survivors, unit_chunk_plan, job_cost_estimate, chunk_cost_estimate, epub_cost_estimate, checks_by_prefix, write_once, cost_by_provider, cost_gate, batch_cost_gate, runaway_output, chunk_outcome, aimd_threads, provider_threads, warm_chunk_size,
    running_cost_cap, batch_cost_cap, cost_source_rollup, batch_rollup, orphan_sweep, job_history_page, job_counts, job_duration, status_guards, latest_duplicate, shortest_first,
    bilingual_interleave, file_router, upload_hashes, upload_checks, upload_delete, job_transitions, job_requests, download_names, effective_settings,
)}

_ACTIVE = ", ".join(f"'{s}'" for s in L.ACTIVE_STATES)
_TERMINAL = ", ".join(f"'{s}'" for s in L.TERMINAL_STATES)
_PRICE = lambda a, b: f"(tokens_in / 1e6::DOUBLE * {a} + tokens_out / 1e6::DOUBLE * {b})"

SQL = {
    "chunk_cost_estimate": f"""SELECT doc_id, tokens_in, tokens_out, round(tokens_in / 1e6::DOUBLE * 1.25::DOUBLE + tokens_out / 1e6::DOUBLE * 10.0::DOUBLE, 9) AS cost_usd FROM (
      SELECT doc_id, tokens_in, trunc(chars * 1.3::DOUBLE * 1.5::DOUBLE / 4.0::DOUBLE)::BIGINT AS tokens_out FROM {_EST})""",
    "epub_cost_estimate": f"""WITH plan AS ({_pack("(SELECT * FROM " + _UNITS + " WHERE NOT blank)")}),
      asked AS (SELECT book, count(*) AS requests FROM (SELECT DISTINCT book, chunk_index, request_index FROM plan WHERE request_index IS NOT NULL) GROUP BY book),
      sums AS (SELECT book, count(*) AS units, trunc(sum(n) * 1.15::DOUBLE)::BIGINT + 30 * count(*) AS chars FROM {_UNITS} WHERE NOT blank GROUP BY book)
      SELECT book AS source, units, requests, chars, trunc(chars / 4.0::DOUBLE + requests * 1314 / 4.0::DOUBLE)::BIGINT AS tokens_in, trunc(chars * 1.16::DOUBLE / 2.0::DOUBLE)::BIGINT AS tokens_out
      FROM sums LEFT JOIN asked USING (book)""",
    "checks_by_prefix": """SELECT status, count(*) AS checks, min(name) AS first_name FROM (SELECT o_orderstatus AS status, ['babeldoc_', 'babeldocs', 'layout_', 'babeldoc'][o_orderkey % 4 + 1] || o_custkey AS name FROM orders)
      WHERE regexp_full_match(name, 'babeldoc..*') GROUP BY status""",
    "write_once": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'en' ELSE 'fr' END WHEN o_totalprice > 100000 THEN 'fr' ELSE 'en' END AS lang,
      (CASE WHEN o_orderkey % 5 = 0 THEN 25 WHEN o_custkey % 2 = 0 THEN 50 ELSE 10 END)::INT AS chunk_size FROM orders""",
    "page_chunk_plan": f"SELECT * FROM {_CHUNKS}",
    "chunk_survivors": f"SELECT job_id, chunk_index, CASE WHEN chunk_index > 0 THEN overlap_end + 1 ELSE page_start END AS kept_start, page_end AS kept_end FROM {_CHUNKS}",
    "unit_chunk_plan": _pack(_UNITS),
    "job_cost_estimate": f"SELECT * FROM {_EST}",
    "cost_by_provider": f"""SELECT provider, model, round(sum({_PRICE('a', 'b')}), 4) AS cost_usd, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out
      FROM {_EST} CROSS JOIN (VALUES {_OFFERS}) v(provider, model, a, b) GROUP BY ALL
      UNION ALL SELECT 'deepl', '', round(sum((tokens_in + tokens_out) * 4 / 1e6::DOUBLE * 25), 4), sum(tokens_in)::BIGINT, sum(tokens_out)::BIGINT FROM {_EST}""",
    "cost_gate": f"SELECT doc_id, round(c, 9) AS cost_usd, round(c * 2, 9) AS high_usd, round(c, 9) > 0.02 AS rejected FROM (SELECT doc_id, {_PRICE('2.5::DOUBLE', '10.0::DOUBLE')} AS c FROM {_EST})",
    "batch_cost_gate": f"SELECT source, round(sum(c), 6) AS cost_usd, round(sum(c), 6) > 1.0 AS rejected FROM (SELECT source, {_PRICE('2.0::DOUBLE', '10.0::DOUBLE')} AS c FROM {_EST}) GROUP BY source",
    "runaway_output": "SELECT doc_id, answer_tokens, expected, answer_tokens > greatest(3.0 * expected, 1500) AS runaway FROM (SELECT doc_id, (doc_id * 37) % 6000 AS answer_tokens, trunc(length(text) * 1.16::DOUBLE / 2.0::DOUBLE)::BIGINT AS expected FROM documents)",
    "chunk_outcome": f"SELECT event_id, outcome FROM {_OUT}",
    "aimd_threads": f"SELECT user_id, s.threads AS threads, s.streak AS streak, s.seen AS observations FROM {_AIMD}",
    "provider_threads": _PROVIDER_AIMD,
    "warm_chunk_size": f"SELECT user_id, CASE WHEN s.seen >= 3 AND s.streak >= 3 THEN 40 ELSE 20 END AS chunk_size FROM {_AIMD}",
    "running_cost_cap": """SELECT l_orderkey AS job_id, count(*) AS chunks_run, round(sum(l_extendedprice), 2) AS spent, round(sum(l_extendedprice), 2) > 100000 AS cost_capped FROM (
      SELECT *, coalesce(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lineitem)
      WHERE b <= 100000 GROUP BY l_orderkey""",
    "batch_cost_cap": f"""SELECT job_id, batch_id, round(b, 2) AS spent_before, round(b, 2) > 500000 AS skipped FROM (
      SELECT *, coalesce(sum(cost) OVER (PARTITION BY batch_id ORDER BY total_pages, file_bytes, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {_JOBS})""",
    "cost_source_rollup": """SELECT l_orderkey AS job_id, CASE WHEN count(*) FILTER (WHERE l_discount > 0.01) > 0 AND count(*) FILTER (WHERE l_discount > 0.01 AND l_returnflag = 'A') = 0 THEN 'metered' ELSE 'estimated' END AS cost_source,
      round(sum(CASE WHEN l_discount > 0.01 THEN l_extendedprice ELSE 0 END), 6) AS actual_cost FROM lineitem GROUP BY l_orderkey""",
    "batch_rollup": f"SELECT batch_id, count(*) AS jobs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM {_JOBS} GROUP BY batch_id",
    "orphan_sweep": f"SELECT job_id, CASE WHEN status IN ({_ACTIVE}) THEN 'failed' ELSE status END AS status, CASE WHEN status IN ({_ACTIVE}) THEN coalesce(finished_at, TIMESTAMP '2024-06-01') ELSE finished_at END AS finished_at FROM {_JOBS}",
    "job_history_page": f"SELECT job_id, status, created_at FROM {_JOBS} WHERE status IN ('completed', 'failed') ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40",
    "job_counts": f"SELECT status, count(*) AS jobs, count(*) FILTER (WHERE total_pages > 200) AS long_jobs FROM {_JOBS} GROUP BY status",
    "job_duration": f"SELECT job_id, CASE WHEN status IN ({_TERMINAL}) THEN (epoch(finished_at) - epoch(created_at))::BIGINT END AS duration_seconds, round_even(total_pages / 400 * 100, 1) AS progress_percent FROM {_JOBS}",
    "status_guards": f"SELECT job_id, status IN ('failed', 'cancelled', 'cost_capped') AS can_retry, status NOT IN ({_ACTIVE}) AS can_delete, status NOT IN ('completed', 'failed', 'cancelled') AS can_cancel FROM {_JOBS}",
    "latest_duplicate": "SELECT doc_id, latest, copies FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS latest, count(*) OVER (PARTITION BY text) AS copies FROM documents) WHERE doc_id <> latest",
    "shortest_first": f"SELECT batch_id, job_id, row_number() OVER (PARTITION BY batch_id ORDER BY coalesce(nullif(total_pages, 0), file_bytes), job_id) AS place FROM {_JOBS}",
    "bilingual_interleave": """WITH p AS (SELECT source AS book, doc_id, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS pos FROM documents WHERE lang IN ('en', 'fr')),
      n AS (SELECT book, count(*) AS n FROM p WHERE lang = 'en' GROUP BY book)
      SELECT book, doc_id, row_number() OVER (PARTITION BY book ORDER BY pos, lang) AS place FROM p JOIN n USING (book) WHERE pos <= n""",
    "file_router": """SELECT file, round(ratio, 9) AS ratio, CASE WHEN ratio > 0.9 THEN 'pdf_digital' ELSE 'pdf_scan' END AS file_type FROM (
      SELECT source AS file, CASE WHEN count(*) = count(*) FILTER (WHERE n_chars <= 400 AND doc_id % 3 = 0) THEN 0 ELSE count(*) FILTER (WHERE n_chars > 400) / (count(*) - count(*) FILTER (WHERE n_chars <= 400 AND doc_id % 3 = 0)) END AS ratio FROM documents GROUP BY source)""",
    "upload_checks": """WITH u AS (SELECT page_id, strlen(html) * (page_id % 9) * 100000 AS n_bytes, CASE WHEN page_id % 11 > 0 THEN 'book' || page_id || ['.pdf', '.EPUB', '.txt', '', '.tar.Pdf', ''][page_id % 6 + 1] END AS stored FROM pages)
      SELECT page_id, stored, CASE WHEN stored IS NULL THEN 'no_name' WHEN NOT (lower(stored) LIKE '%.pdf' OR lower(stored) LIKE '%.epub') THEN 'extension' WHEN n_bytes > 524288000 THEN 'too_large' ELSE 'ok' END AS result FROM u""",
    "upload_delete": "SELECT o_orderkey AS job_id, o_custkey AS file_id, EXISTS (SELECT 1 FROM pages WHERE page_id = o_custkey AND page_id % 4 > 0) AS file_there FROM orders",
    "job_transitions": f"""SELECT job_id, CASE WHEN r = 'retry' AND can THEN 'queued' ELSE status END AS status, CASE WHEN r = 'retry' AND can THEN false WHEN r = 'cancel' AND runs THEN true ELSE mark END AS cancel_requested,
      CASE WHEN r = '' THEN 'none' WHEN r = 'retry' AND can THEN 'queued' WHEN r = 'cancel' AND runs THEN 'marked' ELSE 'refused' END AS result FROM (
      SELECT job_id, status, batch_id % 2 = 0 AS mark, ['retry', 'cancel', ''][batch_id % 3 + 1] AS r, status IN ('failed', 'cancelled', 'cost_capped') AS can, status NOT IN ('completed', 'failed', 'cancelled') AS runs FROM {_JOBS})""",
    "job_requests": """WITH RECURSIVE q AS (SELECT o_orderkey AS id, o_orderdate AS ts, CASE WHEN o_orderkey % 23 > 0 THEN (o_custkey // 10)::VARCHAR END AS hash, CASE WHEN o_orderkey % 3 = 0 THEN 'epub' ELSE 'pdf' END AS ft,
        CASE WHEN o_orderkey % 17 = 0 THEN 'other' WHEN o_orderkey % 6 = 0 THEN 'parse_only' ELSE 'translate' END AS kind, o_orderkey % 7 = 0 AS deepl, o_totalprice / 100000 AS cost, o_orderkey % 5 = 0 AS confirm, o_orderkey % 13 = 0 AS force,
        CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + to_days((o_orderkey % 90)::INT) END AS done FROM orders),
      g AS (SELECT *, CASE WHEN hash IS NULL THEN 'not_found' WHEN kind = 'other' THEN 'job_type' WHEN kind = 'translate' AND deepl AND ft = 'pdf' THEN 'provider' WHEN kind = 'translate' AND cost > 2 AND NOT confirm THEN 'cost' END AS reason FROM q WHERE id % 10 <> 1),
      n AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ts, id) AS rn FROM g WHERE reason IS NULL AND kind = 'translate'),
      old AS (SELECT hash, list({'ts': done, 'job': id::VARCHAR}) AS jobs FROM q WHERE id % 10 = 1 AND kind = 'translate' AND done IS NOT NULL AND hash IS NOT NULL GROUP BY hash),
      s AS (SELECT DISTINCT n.hash, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::VARCHAR AS result, NULL::VARCHAR AS job, coalesce(jobs, []) AS jobs FROM n LEFT JOIN old USING (hash)
        UNION ALL
        SELECT hash, rn, id, CASE WHEN dup IS NULL THEN 'created' ELSE 'duplicate' END, CASE WHEN dup IS NULL THEN 'r' || id ELSE dup.job END,
          CASE WHEN dup IS NULL AND done IS NOT NULL THEN list_append(jobs, {'ts': done, 'job': 'r' || id}) ELSE jobs END
        FROM (SELECT n.hash, n.rn, n.id, n.done, s.jobs, CASE WHEN NOT n.force THEN list_max(list_filter(s.jobs, lambda j: j.ts <= n.ts)) END AS dup FROM s JOIN n ON n.hash = s.hash AND n.rn = s.rn + 1))
      SELECT g.id AS request_id, CASE WHEN g.reason IS NOT NULL THEN 'rejected' ELSE coalesce(s.result, 'created') END AS result, g.reason, CASE WHEN g.reason IS NULL THEN coalesce(s.job, 'r' || g.id) END AS job
      FROM g LEFT JOIN s ON s.id = g.id""",
    "upload_hashes": "SELECT page_id, sha256(html) AS sha256, strlen(html) AS n_bytes FROM pages",
    "download_names": f"SELECT job_id, 'book' || job_id || '_bilingual_' || strftime(coalesce(finished_at, created_at), '%Y%m%d-%H%M%S') || '.pdf' AS name FROM {_JOBS}",
    "effective_settings": "SELECT * FROM (VALUES ('cap', '2.0', NULL), ('enabled', 'off', false), ('threads', '16', NULL), ('overlap', '2', NULL)) v(key, value, flag)",
}
