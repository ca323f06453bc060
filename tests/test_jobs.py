import pytest
from pyspark.sql import functions as F

from quarry.operators import control, planning, records


def chunks(spark, pages, file_bytes=0, **k):
    df = spark.createDataFrame([(1, pages, file_bytes)], "job_id long, total_pages long, file_bytes long")
    return [(r["page_start"], r["page_end"], r["overlap_start"], r["overlap_end"]) for r in planning.page_chunks(df, **k).orderBy("chunk_index").collect()]


def test_page_chunks(spark):
    assert chunks(spark, 50, 20 << 20) == [(1, 50, None, None)]
    assert chunks(spark, 51) == [(1, 40, None, None), (39, 51, 39, 40)]
    assert chunks(spark, 50, (20 << 20) + 1) == [(1, 40, None, None), (39, 50, 39, 40)]
    assert chunks(spark, 120) == [(1, 40, None, None), (39, 80, 39, 40), (79, 120, 79, 80)]
    assert chunks(spark, 0) == []
    for bad in ({"size": 0}, {"overlap": 40}, {"overlap": -1}):
        with pytest.raises(ValueError):
            chunks(spark, 10, **bad)


@pytest.mark.parametrize("pages, size, overlap", [(418, 40, 2), (97, 7, 3), (60, 13, 0)])
def test_survivors_cover_each_page_once(spark, pages, size, overlap):
    df = spark.createDataFrame([(1, pages, 1 << 30)], "job_id long, total_pages long, file_bytes long")
    kept = planning.survivors(planning.page_chunks(df, size, overlap)).orderBy("chunk_index").collect()
    assert [p for r in kept for p in range(r["kept_start"], r["kept_end"] + 1)] == list(range(1, pages + 1))


def packed(spark, sizes):
    df = spark.createDataFrame([("b", i, n) for i, n in enumerate(sizes)], "book string, unit_idx long, n long")
    return [(r["chunk_index"], r["request_index"]) for r in planning.pack_units(df).orderBy("unit_idx").collect()]


def test_unit_packing(spark):
    assert [c for c, _ in packed(spark, [3000] * 7)] == [0, 0, 0, 1, 1, 1, 2]
    assert [r for _, r in packed(spark, [100] * 7)] == [0] * 6 + [1]
    assert [r for _, r in packed(spark, [600, 500, 1])] == [0, 0, 1]
    assert [c for c, _ in packed(spark, [8000, 1])] == [0, 1]
    assert packed(spark, [10_000, 5])[1] == (1, 0)
    assert packed(spark, [10_001, 5]) == [(None, None)] * 2


def test_cost_anchor(spark):
    r = spark.range(1).select(planning.input_tokens(F.lit(699_103), F.lit(2989), F.lit("en"), 1314).alias("i"), planning.output_tokens(F.lit(699_103)).alias("o")).first()
    assert (r["i"], r["o"]) == (1_156_662, 405_479)
    assert 1.0 <= (r["i"] + r["o"]) / 1_548_096 <= 1.6


def test_prices_and_defaults(spark):
    rows = [("openai", "gpt-4o-mini", 1_000_000, 1_000_000), ("openai", "new", 1_000_000, 0), ("deepl", "", 500_000, 500_000), ("ollama", "x", 9, 9)]
    got = {(r["provider"], r["model"]): r["cost_usd"] for r in planning.priced(spark.createDataFrame(rows, "provider string, model string, tokens_in long, tokens_out long")).collect()}
    assert got == {("openai", "gpt-4o-mini"): pytest.approx(0.75), ("openai", "new"): 2.5, ("deepl", ""): 100.0, ("ollama", "x"): 0.0}


def test_runaway_and_cap_are_strict(spark):
    f = lambda chars, n: spark.range(1).select(planning.runaway(F.lit(chars), F.lit(n))).first()[0]
    assert not f(10, 1500) and f(10, 1501) and not f(2000, 3480) and f(2000, 3481)
    df = spark.createDataFrame([(1, 1, 60.0), (1, 2, 40.0), (1, 3, None), (1, 4, 0.01), (1, 5, 1.0)], "j long, i long, c double")
    assert [r["i"] for r in planning.running_cap(df, "j", ["i"], "c", 100.0).orderBy("i").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("code, hits, secs, want", [(None, 0, 1, "timeout_silent"), (None, 1, 1, "timeout_signalled"), (0, 1, 1, "rate_limited"), (2, 0, 1, "error"), (0, 0, 75.0, "success"), (0, 0, 75.1, "slow_success")])
def test_outcomes(spark, code, hits, secs, want):
    assert spark.range(1).select(control.outcome(F.lit(code).cast("int"), F.lit(hits), F.lit(secs), F.lit(100.0))).first()[0] == want


def test_threads(spark):
    log = [(1, i, o) for i, o in enumerate(["success"] * 14 + ["rate_limited", "error", "timeout_silent", "timeout_signalled", "success"])]
    r = control.thread_counts(spark.createDataFrame(log, "k long, i long, outcome string"), "k", ["i"]).first()
    assert (r["threads"], r["streak"], r["observations"]) == (10, 1, 19)


def test_cost_source_and_orphans(spark):
    rows = [(1, 1.0, "metered"), (1, None, "estimated"), (2, 1.0, "metered"), (2, 2.0, None), (3, None, "metered")]
    got = {r["j"]: r["cost_source"] for r in control.cost_source(spark.createDataFrame(rows, "j long, c double, s string"), "j", "c", "s").collect()}
    assert got == {1: "metered", 2: "estimated", 3: "estimated"}
    jobs = spark.createDataFrame([(1, "merging", None, "now"), (2, "parsing", "then", "now"), (3, "cost_capped", None, "now")], "job_id long, status string, finished_at string, now string")
    once = control.sweep_orphans(jobs)
    assert sorted(once.collect()) == [(1, "failed", "now"), (2, "failed", "then"), (3, "cost_capped", None)]


def test_contents_and_lists(spark):
    line = lambda t, left=0.0, gap=10.0: [(left + i * 5.0 + (gap if c.isdigit() else 0), left + i * 5.0 + 5 + (gap if c.isdigit() else 0), c, 10.0) for i, c in enumerate(t)]
    assert records.contents_cuts("text", [line("Bread1"), line("Cakes9"), line("Pies12")]) == ("fired", [0, 1])
    assert records.contents_cuts("text", [line("Bread1"), line("more", 20.0), line("Cakes9"), line("Pies12")]) == ("fired", [1, 2])
    assert records.contents_cuts("text", [line("Bread9"), line("Cakes1")])[0] == "not_monotonic"
    assert records.contents_cuts("Table ", [line("Bread1"), line("Cakes9")])[0] == "deny_layout"
    assert records.contents_cuts(None, [line("Bread1")])[0] == "too_short"
    assert records.contents_cuts(None, [line("Bread1", gap=0.0), line("Cakes9", gap=0.0)])[0] == "few_tail_lines"
    assert records.contents_cuts(None, [line("Bread1"), line("x"), line("y"), line("Cakes9")])[0] == "low_fraction"
    g = spark.createDataFrame([(["1. a", "b", "2. c", "4. d", "3. e"],), (["a", "1. b"],), ([],)], "l array<string>").select(records.numbered_groups(F.col("l"))).collect()
    assert [list(r[0]) for r in g] == [[0, 0, 1, 1, 2], [0, 0], []]


def test_uploads_by_hand(spark):
    rows = [("a.pdf", 1), ("../../etc/x.EPUB", 500 << 20), ("b.epub", (500 << 20) + 1), ("c.pdf.txt", 1), (".pdf", 1), ("", 1), (None, 1), ("d/e.Pdf/", 1), ("plain", 1)]
    stored, result = control.upload_check(F.col("n"), F.col("b"))
    got = [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, b long").orderBy("i").select(stored, result).collect()]
    assert got == [("a.pdf", "ok"), ("x.EPUB", "ok"), ("b.epub", "too_large"), ("c.pdf.txt", "extension"), (".pdf", "extension"), ("", "no_name"), (None, "no_name"), ("e.Pdf", "ok"), ("plain", "extension")]


def test_transitions_by_hand(spark):
    rows = [("failed", True, "retry"), ("cost_capped", False, "retry"), ("completed", False, "retry"), ("cost_capped", False, "cancel"), ("failed", False, "cancel"), ("queued", False, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status string, cancel_requested boolean, request string")
    got = [(r["status"], r["cancel_requested"], r["result"]) for r in control.transitions(df).orderBy("i").collect()]
    assert got == [("queued", False, "queued"), ("queued", False, "queued"), ("completed", False, "refused"), ("cost_capped", True, "marked"), ("failed", False, "refused"), ("queued", False, "none")]
