"""Plans and sums over one hot key, against folds; records of any depth; reports that can't be trusted."""

import json
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import lexicon
from quarry.operators import control, planning, records


@pytest.fixture
def many_ranges(spark):
    """Ranges as they fall, so that one key lies in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def fold(sizes, chunk_chars=8000, request_chars=1100, request_units=6):
    chunk = request = run = chars = count = 0
    out = []
    for n in sizes:
        if count and (chars + n > request_chars or count >= request_units):
            request, chars, count = request + 1, 0, 0
        out.append((chunk, request))
        run, chars, count = run + n, chars + n, count + 1
        if run >= chunk_chars:
            chunk, request, run, chars, count = chunk + 1, 0, 0, 0, 0
    return out


@pytest.mark.parametrize("seed", range(6))
def test_what_a_block_does_to_any_open_chunk(seed):
    rng = np.random.default_rng(seed)
    full = int(rng.integers(1, 60))
    sizes = rng.integers(0, [2, 5, 100][seed % 3], int(rng.integers(1, 80)))
    least, starts, lengths, closed = planning.chunk_map(sizes, full)
    for opened in range(full):
        run, n = opened, 0
        for size in sizes:
            run += int(size)
            if run >= full:
                run, n = 0, n + 1
        if opened < least:
            assert (run, n) == (opened + int(sizes.sum()), 0)
        else:
            k = int(np.searchsorted(starts, opened, side="right")) - 1
            assert (lengths[k], closed[k]) == (run, n)


def test_a_hot_book_is_packed_in_blocks(spark, many_ranges):
    rng = random.Random(2)
    books = {"hot": [rng.choice([0, 3, 40, 700, 9_999]) for _ in range(3000)], "a": [100] * 50, None: [rng.randrange(900) for _ in range(70)], "z": [0] * 40, "bad": [5, 10_001, 5]}
    rows = [(book, i // 10, i % 10, n) for book, sizes in books.items() for i, n in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "book string, doc long, line int, n int")
    got = {(r["book"], r["doc"] * 10 + r["line"]): (r["chunk_index"], r["request_index"]) for r in planning.pack_units(df, ["doc", "line"], block=64).collect()}
    want = {(book, i): (None, None) if book == "bad" else x for book, sizes in books.items() for i, x in enumerate(fold(sizes))}
    assert got == want
    assert planning.pack_units(df.limit(0), ["doc", "line"]).count() == 0


def test_a_hot_jobs_costs_are_summed_in_ranges(spark, many_ranges):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"j{i % 7}" if i % 2 else None, i, rng.choice([None, 0.1, 0.2, 19.99, 1e6 / 3])) for i in range(2000)]
    df = spark.createDataFrame(rows, "job string, seq long, cost double")
    got = {(r["job"], r["seq"]): r["spent_before"] for r in control.spent_before(df, ["job"], ["seq"], "cost").collect()}
    so_far = {}
    for job, seq, cost in sorted(rows, key=lambda r: r[1]):
        assert got[job, seq] == so_far.get(job, Decimal(0))
        so_far[job] = so_far.get(job, Decimal(0)) + Decimal(str(round(cost or 0, 6))).quantize(Decimal("0.000001"))
    kept = planning.running_cap(df, "job", ["seq"], "cost", 1000.0)
    assert {(r["job"], r["seq"]) for r in kept.collect()} == {k for k, v in got.items() if v <= 1000}


def test_pages_meet_the_ranges_near_them(spark):
    kept = [(1, 0, 1, 40), (1, 1, 41, 41), (1, 2, 42, 500), (2, 0, 1, 7), (3, 0, 9, 8)]
    pages = [(j, p) for j in (1, 2, 3, 4) for p in (1, 7, 8, 40, 41, 42, 79, 80, 500, 501)]
    got = planning.assign_pages(spark.createDataFrame(pages, "job_id int, page int"), spark.createDataFrame(kept, "job_id int, chunk_index int, kept_start int, kept_end int"))
    assert sorted(map(tuple, got.collect())) == sorted((j, p, c) for j, p in pages for k, c, a, b in kept if j == k and a <= p <= b)


def test_floors_by_engine_and_provider(spark, many_ranges):
    rows = [(e, p, "m", i, "rate_limited" if i % 5 == 4 else "success") for e in ("plain", "layout") for p in ("deepseek", "gemini", "unknown") for i in range(5)]
    df = spark.createDataFrame(rows, "engine string, provider string, model string, i long, outcome string")
    got = control.thread_counts(df, ["engine", "provider", "model"], ["i"], control.thread_floor(F.col("engine"), F.col("provider")))
    assert {(r["engine"], r["provider"]): (r["threads"], r["streak"], r["observations"]) for r in got.collect()} == {
        ("plain", "deepseek"): (8, 0, 5), ("plain", "gemini"): (6, 0, 5), ("layout", "deepseek"): (6, 0, 5), ("layout", "gemini"): (5, 0, 5),
    }
    one = control.thread_counts(df.where("i = 4"), ["engine", "provider"], ["i"], control.thread_floor(F.col("engine"), F.col("provider")))
    assert {(r["engine"], r["provider"]): r["threads"] for r in one.collect()} == {(e, p): n for e, p, n in lexicon.THREAD_FLOORS if p in ("deepseek", "gemini")}


def test_spans_of_blocks_at_any_depth(spark):
    def block(depth):
        own = {"lines": [{"spans": [{"type": "text", "content": f"d{depth}", "bbox": [0, 0, 1, 1.5], "score": depth / 10}, {"type": "image"}]}, {"spans": None}, {}]}
        return {**own, "blocks": [block(depth + 1), {"lines": None, "blocks": None}]} if depth < 40 else own

    whole = json.dumps({"pdf_info": [{"page_idx": 3, "preproc_blocks": [block(0)], "discarded_blocks": [block(39)]}, {"page_idx": 4}, {"page_idx": 5, "preproc_blocks": None}]})
    docs = spark.createDataFrame([("a", whole), ("b", whole[:-5]), ("c", "[]"), ("d", '{"pdf_info": 7}'), ("e", None)], "doc string, raw string")
    spans = records.ocr_spans(docs)
    rows = [(r["doc"], r["page"], r["part"], r["content"], r["score"]) for r in spans.where("type = 'text'").collect()]
    assert sorted(rows) == sorted([("a", 3, "body", f"d{k}", k / 10) for k in range(41)] + [("a", 3, "discarded", f"d{k}", k / 10) for k in (39, 40)])
    assert spans.where("type = 'image' and score is null and bbox is null").count() == 43
    q = records.ocr_quality(spans).collect()
    assert [(r["doc"], r["spans"], r["dropped"]) for r in q] == [("a", 43, 1)]
    assert records.ocr_spans(docs.limit(0)).count() == 0


def test_drop_reports(spark):
    lines = [
        '{"type":"header"}', '{"type":"page","page_number_1based":1,"dropped_count":2}', '{"type":"drop","page_number_1based":1}', "{broken", "[]", "", "  ", '{"type":"page","page_number_1based":1,"dropped_count":1}',
        '{"type":"drop","page_number_1based":2,"debug_id":"x"}', '{"type":"page","page_number_1based":3,"dropped_count":0}', '{"type":"new"}', "{}",
    ]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)] + [("b", 0, "nothing")], "log string, line_no long, line string")
    log = records.drop_log(df)
    assert sorted(map(tuple, records.drop_audit(log).collect())) == [("a", 1, 1, 1, False), ("a", 2, None, 1, True), ("a", 3, 0, 0, False)]
    assert sorted(map(tuple, records.drop_summary(log).collect())) == [("a", True, 1, 2, 2, 2), ("b", False, 0, 1, 0, 0)]
    for bad in ('{"type":"page","dropped_count":2}', '{"type":"page","page_number_1based":1}', '{"type":"drop","debug_id":"x"}'):
        refused = records.drop_log(spark.createDataFrame([("a", 1, bad)], "log string, line_no long, line string"))
        with pytest.raises(Exception, match="record without page"):
            records.drop_audit(refused).collect()


def test_caps_follow_the_order_of_doubles(spark, many_ranges):
    """0.1 three times is more than 0.3 as doubles, in SQL too: what meets the cap exactly is decided by them, wherever ranges end."""
    rows = [(j, k, c) for j in range(60) for k, c in enumerate([0.1, 0.1, 0.1, 5.0] if j % 2 else [0.2, 0.1, 5.0] if j % 3 else [0.1, None, 0.1, 0.05, 5.0])]
    df = spark.createDataFrame(rows, "job long, seq long, cost double").repartition(7)
    kept = {(r["job"], r["seq"]) for r in planning.running_cap(df, "job", ["seq"], "cost", 0.3).collect()}
    so_far, want = {}, set()
    for j, k, c in rows:
        want |= {(j, k)} if so_far.get(j, 0.0) <= 0.3 else set()
        so_far[j] = so_far.get(j, 0.0) + (c or 0.0)
    assert kept == want and (1, 3) not in kept and (3, 3) not in kept and (0, 4) in kept


def test_ranges_meet_ranges_as_their_pages_do(spark):
    """No page goes through a shuffle: it is counted out after the join."""
    kept = spark.createDataFrame([(1, 0, 1, 40), (1, 1, 41, 41), (1, 2, 42, 500), (2, 0, 1, 7), (3, 0, 9, 8), (5, 0, 3, 4), (5, 0, 3, 4)], "job_id int, chunk_index int, kept_start int, kept_end int")
    rows = [(1, 1, 43), (1, 499, 510), (2, 5, 4), (2, 7, 9), (3, 1, 20), (4, 1, 2), (5, 1, 9), (5, 4, 4)]
    got = planning.assign_ranges(spark.createDataFrame(rows, "job_id int, page_start int, page_end int"), kept)
    pages = spark.createDataFrame([(j, p) for j, a, b in rows for p in range(a, b + 1)], "job_id int, page int")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, planning.assign_pages(pages, kept).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
