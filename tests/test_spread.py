"""Operators whose hot keys are spread, or pass one by one, against plain versions; XHTML."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import html
from quarry.operators import control, layout, planning, records
from quarry.sources import epub


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_numbered_spreads_a_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 6 == 0, F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"), ((F.col("id") * 7919) % 3000).alias("o"))
        for order, sign in ((["o"], 1), ([F.desc("o")], -1)):
            rows = control.numbered(df, ["key"], order).collect()
            by_key = {}
            for r in rows:
                by_key.setdefault(r["key"], []).append((r["pos"], sign * r["o"]))
            assert len(rows) == 3000 and None in by_key
            for places in by_key.values():
                places.sort()
                assert [p for p, _ in places] == list(range(1, len(places) + 1)) and [o for _, o in places] == sorted(o for _, o in places)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert control.numbered(df.limit(0), ["key"], ["o"]).count() == 0


def _boxes(rng, n):
    out = []
    for i in range(n):
        x, y = rng.choice([-128.0, 0.0, 128.0, rng.uniform(-300, 600)]), rng.uniform(-300, 600)
        out.append((rng.randrange(2), i, x, y, x + rng.choice([0.0, 128.0, rng.uniform(-5, 300)]), y + rng.choice([128.0, rng.uniform(1, 400)])))
    return out


def test_boxes_meet_as_in_all_pairs(spark):
    rng = random.Random(5)
    left, right = _boxes(rng, 60), _boxes(rng, 50)
    left += [(0, 100, -1e9, -1e12, 1e9, 1e15), (1, 101, 5.0, -4e9, 6.0, 4e9)]
    right += [(0, 100, -1e300, -5.0, 1e300, 50.0), (1, 101, 0.0, 0.0, 3e18, 300.0)]
    nan, inf = float("nan"), float("inf")
    odd = [(0, 200, nan, 0.0, 1.0, 1.0), (0, 201, 0.0, 0.0, inf, 1.0), (1, 202, -inf, -inf, inf, inf), (1, 203, 0.0, 0.0, 9.0, nan)]
    schema = "page int, block int, x0 double, y0 double, x1 double, y1 double"

    def shared(a, b):
        return max(min(a[4], b[4]) - max(a[2], b[2]), 0.0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0.0)

    want = sorted((a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and shared(a, b) > 0)
    got = layout.meeting(spark.createDataFrame([*left, *odd, (0, 99, None, 0.0, 1.0, 1.0)], schema), spark.createDataFrame([*right, *odd], schema), layout.CELL)
    assert sorted((r["page"], r["block"], r["o_block"]) for r in got.collect()) == want and want


def test_lines_meet_spans_as_in_all_pairs(spark):
    rng = random.Random(6)
    lines = [(rng.randrange(2), i, "abcdefgh"[: rng.randrange(3, 9)], rng.uniform(-50, 200), rng.uniform(-50, 200), rng.choice([0.0, 30.0, 90.0])) for i in range(40)]
    spans = [(rng.randrange(2), i, "abcdefgh"[: rng.randrange(2, 9)], rng.uniform(-50, 200), rng.uniform(-50, 200)) for i in range(60)]
    from difflib import SequenceMatcher

    want = []
    for p, i, t, x, y, h in lines:
        near = [(round(SequenceMatcher(None, t, c).ratio(), 6), -k) for q, k, c, sx, sy in spans if p == q and ((x - sx) ** 2 + (y - sy) ** 2) ** 0.5 < 0.5 * h]
        want += [(p, i, -max(near)[1], max(near)[0])] if near and max(near)[0] >= 0.6 else []
    got = records.match_lines(spark.createDataFrame(lines, "page int, line int, text string, cx double, cy double, height double"), spark.createDataFrame(spans, "page int, span int, content string, sx double, sy double"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_whole_texts_over_batches(spark, small_batches):
    rows = [("a" if i % 3 else "b", i, None if i % 5 == 0 else "" if i % 7 == 0 else f"téxt {i}") for i in range(50)] + [("c", 1, ""), (None, 1, "x"), (None, 2, "y")]
    got = {r["book"]: (r["total_chars"], r["sha256"], r["pages"]) for r in records.whole_texts(spark.createDataFrame(rows, "book string, pos long, text string")).collect()}
    want = {}
    for book in ("a", "b", "c", None):
        pages = [t for b, _, t in rows if b == book]
        text = "\n\n".join(t for t in pages if t)
        want[book] = (len(text), hashlib.sha256(text.encode()).hexdigest(), len(pages))
    assert got == want


def test_units_are_packed_over_batches(spark, small_batches):
    rows = [(b, i, (i * 37) % 900) for b in ("a", "b") for i in range(60)] + [("long", i, 20_000 if i == 30 else 5) for i in range(40)]
    got = {(r["book"], r["unit_idx"]): (r["chunk_index"], r["request_index"]) for r in planning.pack_units(spark.createDataFrame(rows, "book string, unit_idx long, n int")).collect()}
    assert len(got) == len(rows) and all(got[("long", i)] == (None, None) for i in range(40))
    chunk = request = run = chars = count = 0
    for i in range(60):
        n = (i * 37) % 900
        if count and (chars + n > 1100 or count >= 6):
            request, chars, count = request + 1, 0, 0
        assert got[("a", i)] == got[("b", i)] == (chunk, request)
        run, chars, count = run + n, chars + n, count + 1
        if run >= 8000:
            chunk, request, run, chars, count = chunk + 1, 0, 0, 0, 0
    assert chunk > 1


PAGE = """<?xml version="1.0" encoding="utf-8"?>
<!DOCTYPE html>
<html xmlns="http://www.w3.org/1999/xhtml"><body><svg viewBox="0 0 1 1"><linearGradient id="a"/></svg><!-- kept -->
<p><span class="koboSpan" id="k1">One <b>two</b>.</span><span class="koboSpan" id="k2"> Three.</span><span id="page_3"/></p><p>x&nbsp;&amp;<br/>y</p></body></html>"""


def test_xhtml_keeps_names_and_unwraps_spans():
    units = [(o, h) for o, _, h, _ in html.units(PAGE, html.parse_xhtml)]
    assert units == [(0, 'One <b>two</b>. Three.<span id="page_3"></span>'), (1, "x\xa0&amp;<br/>y")]
    out = html.translated(PAGE, {1: "z"}, read=html.parse_xhtml)
    assert 'viewBox="0 0 1 1"' in out and "<linearGradient" in out and "<!-- kept -->" in out and out.startswith('<?xml version="1.0"') and "<p>z</p>" in out and "koboSpan" not in out
    assert html.well_formed(out) and not html.well_formed("<p>a<p>") and not html.well_formed("<p>&nothing;</p>")
    assert html.parse_xhtml("<P>open<p>a &zzz; b").inner() == "<p>open</p><p>a &amp;zzz; b</p>" and html.parse_xhtml(None).inner() == ""


def test_epub_writes_only_well_formed_documents():
    book = epub.build([("a.xhtml", PAGE), ("b.xhtml", "<p>one</p><p>two</p>")])
    content = epub.rewrite(book, {"OEBPS/a.xhtml#0": "uno"})
    assert b"viewBox" in epub.opened(content).read("OEBPS/a.xhtml") and b"<p>uno</p>" in epub.opened(content).read("OEBPS/a.xhtml")
    with pytest.raises(epub.EpubError, match="well-formed"):
        epub.rewrite(book, {"OEBPS/b.xhtml#0": "eins"})
    linked = epub.build([("a.xhtml", "<p>one <a href='b.xhtml'>b</a></p><p>two</p>"), ("b.xhtml", PAGE)])
    assert epub.drop_documents(linked, {"OEBPS/b.xhtml"}) == (linked, [])
