"""Values by hand, that share no constant with the code."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import glossary, layout, planning, quality, records, terms
from quarry.sources import sinks


def test_french_text_has_no_english_share(spark):
    docs = spark.createDataFrame([(1, "maison et jardin " * 200), (2, "the house and the garden " * 150), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.detect_language(docs, ["doc_id"]).collect()}
    assert (got[1]["token_count"], got[1]["en_share"], got[1]["lang_detected"]) == (600, 0.0, "fr")
    assert got[2]["lang_detected"] == "en" and got[3]["lang_detected"] is None and got[4]["token_count"] == 0


def test_terms_may_begin_with_et_but_not_with_a_function_word(spark):
    docs = spark.createDataFrame([("b", 1, "fromage et. " * 3 + "the cheese. " * 3)], "book string, doc_pos long, text string")
    none = spark.createDataFrame([], "form string")
    got = {r["match_key"] for r in terms.mine(docs, none).collect()}
    assert "fromage et" in got and "the cheese" not in got and "cheese" in got


def test_ranks_lower_common_words(spark):
    docs = spark.createDataFrame([("b", 1, "alpha. " * 4 + "beta. " * 4)], "book string, doc_pos long, text string")
    ranks = spark.createDataFrame([("alpha", 500)], "word string, freq_rank int")
    got = {r["match_key"]: (r["rank_score"], r["place"]) for r in terms.mine(docs, spark.createDataFrame([], "form string"), ranks=ranks).collect()}
    assert got["beta"][1] == 1 and got["alpha"][1] == 2 and got["alpha"][0] == pytest.approx(got["beta"][0] * 0.01)


def test_glossary_terms_are_whole_words_of_any_script(spark):
    docs = spark.createDataFrame([(1, "viên đạn ở nhà, ở đây"), (2, "n n đạn-n"), (3, "λόγος και λόγο"), (4, "ha ha ha ha ha"), (5, "C++ and c++; .net"), (6, "New  York, new york"), (7, None), (8, ""), (6, "New York")], "doc_id long, text string")
    known = spark.createDataFrame([(t,) for t in ["ở", "n", "đạn ở", "λόγο", "ha ha", "c++", ".NET", "new york", "...", ""]], "term_en string")
    got = {(r["doc_id"], r["term_en"]): r["n"] for r in glossary.occurrences(docs, known).collect()}
    assert got == {(1, "ở"): 2, (1, "đạn ở"): 1, (2, "n"): 3, (3, "λόγο"): 1, (4, "ha ha"): 2, (5, "c++"): 2, (5, ".NET"): 1, (6, "new york"): 2}


def test_composition_only_where_marks_are(spark):
    rows = [("é",), ("é",), ("“dash — quote”",), ("Å",), (None,), ("Việt",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.composed(F.col("t"))).collect()]
    assert got == ["é", "é", "“dash — quote”", "Å", None, "Việt"]


def test_estimates(spark):
    row = spark.createDataFrame([(1000, 12)], "chars int, units int").select(planning.chunk_output_tokens(F.col("chars")), planning.epub_inputs(F.col("chars"), F.col("units"))).first()
    assert tuple(row) == (487, 1510)


def test_dropped_paragraphs(spark):
    rows = [(1, "a", "text", 0), (2, "b", "text", None), (3, None, "text", 0), (4, "d", "  ", 0), (5, "e", "text", 3), (6, "f", "x" * 900, 0), (9, "g", "text", 0)]
    got = {r["debug_id"]: (r["text_len"], len(r["text_excerpt"])) for r in layout.dropped(spark.createDataFrame(rows, "page int, debug_id string, text string, rendered int"), 2, 8).collect()}
    assert got == {"b": (4, 4), "f": (900, 400)}


def test_wrapping_and_fit(spark):
    assert records.wrapped("aa bb cccccccccccc d", 25, 10) == ["aa bb", "cccccccccccc", "d"] and records.wrapped("", 10, 10) == []
    rows = [(1, "word " * 10, 100.0, 40.0, 10.0), (2, "word " * 10, 100.0, 30.0, 10.0), (3, "word " * 2000, 100.0, 30.0, 10.0), (4, None, 100.0, 1.0, 10.0)]
    got = {r["block"]: (r["fits"], r["scale"], r["lines"]) for r in spark.createDataFrame(rows, "block long, text string, width double, height double, font double").mapInPandas(records.fit_blocks, "block long, fits boolean, scale double, lines int").collect()}
    assert got[1] == (True, 1.0, 3) and got[2] == (True, 0.82, 2)
    assert not got[3][0] and got[3][1] == 0.7 and got[4] == (True, 1.0, 0)


def test_detector_lines_take_the_most_similar_span_nearby(spark):
    lines = spark.createDataFrame([(1, 1, "hello world", 10.0, 10.0, 20.0), (1, 2, "other", 10.0, 10.0, 20.0), (2, 1, "hello", 0.0, 0.0, 20.0)], "page int, line int, text string, cx double, cy double, height double")
    spans = spark.createDataFrame([(1, 7, "hello worlds", 12.0, 10.0), (1, 8, "hello world", 13.0, 10.0), (1, 9, "hello world", 90.0, 10.0), (2, 3, "hello", 9.0, 9.0)], "page int, span int, content string, sx double, sy double")
    assert [tuple(r) for r in records.match_lines(lines, spans).collect()] == [(1, 1, 8, 1.0)]


def test_findings_have_json_details(spark, tmp_path):
    findings = spark.createDataFrame([(1, "overlap", "critical", (3, 4, 0.25))], "page int, check_type string, severity string, detail struct<block:int,other:int,ratio:double>")
    sinks.write_findings(findings, f"{tmp_path}/f")
    sinks.write_findings(findings.withColumn("detail", F.lit('{"é":1}')), f"{tmp_path}/f")
    got = sorted(r["detail"] for r in spark.read.parquet(f"{tmp_path}/f").collect())
    assert [json.loads(x) for x in got] == [{"block": 3, "other": 4, "ratio": 0.25}, {"é": 1}] and "é" in got[1]


def test_requests_glossary_and_names_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("j", 1, "a"), ("j", 2, "b"), ("k", 1, "c"), ("j", 1, "d")], "job_id string, chunk_index int, body string")
    sinks.write_requests(rows, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/job_id=j/chunk_index=1").count() == 2
    sinks.export_glossary(spark.createDataFrame([("b", "2"), ("A", "1"), ("c, d", '"x"')], "term_en string, term_vi string"), f"{tmp_path}/g")
    (part,) = [p for p in (tmp_path / "g").iterdir() if p.name.endswith(".csv")]
    assert part.read_text().splitlines()[:3] == ["term_en,term_vi", "A,1", "b,2"]
    when = spark.createDataFrame([(datetime.datetime(2026, 1, 2, 3, 4, 5),)], "t timestamp").select(sinks.download_name(F.lit("book"), F.lit("vi"), F.col("t"), F.lit(".pdf"))).first()[0]
    assert when == "book_vi_20260102-030405.pdf"


def test_parse_archives():
    good = sinks.parse_zip("# text", {"b.png": b"1", "a.png": b"2"})
    assert sinks.parse_zip_problem(good, 2) is None and sinks.parse_zip_problem(good, 3) == "images"
    assert sinks.parse_zip_problem(b"no archive", 0) == "corrupt" and sinks.parse_zip_problem(good[:-30], 2) == "corrupt"


def test_copyright_audit_lists_scored_pages(spark, tmp_path):
    from quarry.plans import record_queries

    page = "Copyright © 2020 by X. All rights reserved. No part of this book may be copied."
    rows = [(i, page if i == 2 else "plain words here " * 5, "en", "s", 0) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = record_queries.copyright_audit(spark, str(tmp_path)).collect()
    audit = json.loads(r["audit"])
    assert r["book"] == "s" and audit["checked"] == 15 and [x["doc_pos"] for x in audit["scored"] if x] == [2]
