import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import quality, terms

DOC = "doc_id long, text string"


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def detect(spark, text):
    r = quality.detect_language(spark.createDataFrame([(1, text)], DOC), ["doc_id"]).first()
    return r["lang_detected"], r["token_count"]


def test_language_floor_share_and_ratio(spark):
    assert detect(spark, "the word " * 249 + "the") == (None, 499)
    assert detect(spark, "the word " * 250) == ("en", 500)
    assert detect(spark, "vous mot " * 250) == ("fr", 500)
    assert detect(spark, "de mot " * 250) == (None, 500)  # counts for both
    assert detect(spark, "the " * 24 + "word " * 476) == (None, 500)
    assert detect(spark, "the " * 25 + "word " * 475) == ("en", 500)
    assert detect(spark, "the the the vous " * 125)[0] == "en" and detect(spark, "the the the vous " * 124 + "vous " * 4)[0] is None
    assert detect(spark, None) == (None, 0) and detect(spark, "") == (None, 0)


@pytest.mark.parametrize("n, marked, bad_request, bad_unit", [(199, 0, False, True), (200, 0, True, True), (200, 16, False, False), (39, 0, False, False), (40, 0, False, True), (50, 1, False, False)])
def test_diacritic_gates(spark, n, marked, bad_request, bad_unit):
    r = quality.diacritics(spark.createDataFrame([(1, "<b class='x'>" + "ạ" * marked + "x" * (n - marked) + "</b> 123")], DOC)).first()
    assert (r["letters"], r["bad_request"], r["bad_unit"]) == (n, bad_request, bad_unit)


def test_diacritics_of_decomposed_text(spark):
    import unicodedata

    r = quality.diacritics(spark.createDataFrame([(1, unicodedata.normalize("NFD", "ạ" * 30))], DOC)).first()
    assert (r["letters"], r["ratio"]) == (30, 1.0)
    assert quality.diacritics(spark.createDataFrame([(1, None)], DOC)).first()["letters"] == 0


PAGE = "All rights reserved. ISBN 1. copyright © 2001 published by us"


def pages(spark, texts):
    return spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book string, doc_pos long, text string")


def test_copyright_points_and_limits(spark):
    r = quality.copyright_pages(pages(spark, [PAGE, "ISBN ISBN isbn", "© 2001 x", PAGE + " w" * 590, PAGE + " w" * 589, None])).orderBy("doc_pos").collect()
    assert [x["score"] for x in r] == [9, 2, 3, 9, 9, 0]
    assert [x["is_copyright"] for x in r] == [True, False, False, False, True, False]
    assert r[3]["words"] == 601 and r[4]["words"] == 600


def test_copyright_scan_windows_and_guards(spark):
    scan = lambda texts, **k: {r["doc_pos"]: r for r in quality.copyright_scan(pages(spark, texts), **k).collect()}
    r = scan([PAGE] + ["x"] * 20, head=2, tail=1)
    assert sorted(r) == [0, 1, 20] and r[0]["removed"]
    assert all(x["aborted_reason"] == "too_many_candidates" and not x["removed"] for x in scan([PAGE] * 4 + ["x"] * 9).values())
    assert sum(x["removed"] for x in scan([PAGE] * 3 + ["x"] * 9).values()) == 3
    assert {x["aborted_reason"] for x in scan([PAGE] * 2).values()} == {"would_remove_all_pages"}


def test_term_source_joins_and_strips(spark):
    f = lambda t: one(spark, t, lambda c: T.term_source(c, True))
    assert f("fl our and emulsifi ers") == "flour and emulsifiers"
    assert f("staff members ff oo") == "staff members ffoo"
    assert f("choco-\nlate # x\n## Head ![a](b) <i>ﬁn</i> ’") == "choco" + "late # x\nHead    fin  '"


@pytest.mark.parametrize("word, want", [("berries", "berry"), ("dies", "die"), ("glass", "glass"), ("gas", "gas"), ("cups", "cup")])
def test_singular(spark, word, want):
    assert one(spark, word, T.singular) == want


def mined(spark, text, forms=()):
    docs = spark.createDataFrame([("b", 1, text)], "book string, doc_pos long, text string")
    return {r["match_key"]: r for r in terms.mine(docs, spark.createDataFrame([(f,) for f in forms], "form string")).collect()}


def test_terms_absorption_needs_one_longer_term(spark):
    # no single longer term has 80 % of the word
    r = mined(spark, ". ".join(["gluten network", "gluten network", "gluten strand", "gluten strand", "gluten"]))
    assert "gluten" in r and r["gluten"]["occurrences"] == 5
    assert "gluten" not in mined(spark, ". ".join(["gluten network"] * 4 + ["gluten"]))
    assert "gluten" in mined(spark, ". ".join(["gluten network"] * 3 + ["gluten"]))


def test_terms_flags_plurals_and_glossary(spark):
    r = mined(spark, "we are in Paris Texas. we are in Paris Texas. we are in Paris Texas. cup. cups. cups. cup. oven. oven. NASA. NASA", ["oven"])
    assert "oven" not in r
    assert r["nasa"]["noise_flags"] == "proper_noun" and r["paris texas"]["noise_flags"] == "proper_noun"
    assert r["cup"]["occurrences"] == 4 and r["cup"]["noise_flags"] == "plural_merged"
    assert r["cup"]["rank_score"] == pytest.approx(__import__("math").log(5) * 0.3)


def test_entities_and_markers(spark):
    e = one(spark, "bake at 180 °C with 250 g or 1,5 L for 30 Min or 1/2 h, 3 grams", T.entities)
    assert e == ["180 °C", "250 g", "1,5 L", "30 Min", "2 h", "1/2"]
    assert [one(spark, t, T.list_marker) for t in ("12) x", " 3. y", "1234. z", "3.x", "a")] == [12, 3, None, None, None]


def test_droppable(spark):
    yes = ["", " 12\n3 ", "https://a.b/c?d", "WWW.x.y", "ISBN-13: 978-0-1", "isbn 12 3x"]
    assert [one(spark, t, T.droppable) for t in yes] == [True] * len(yes)
    assert [one(spark, t, T.droppable) for t in ("12 a", "see https://a.b", "ISBN 1 title")] == [False] * 3


def test_ocr_warning(spark):
    jobs = spark.createDataFrame([(1, None, 3), (2, 0.6, 3), (3, 0.125, None)], "job_id long, confidence double, dropped int")
    r = {x["job_id"]: x["warning"] for x in quality.ocr_warning(jobs, 0.6).collect()}
    assert r[1] is None and r[2] is None and "(12%)" in r[3] and " 0 unreadable" in r[3]


def test_ngrams_are_shuffled_and_sorted_once(spark):
    """Surfaces and keys are added up after one shuffle and one sort; earlier documents win ties, whatever batch they come in."""
    docs = spark.createDataFrame([("a", 7, "Sour Dough! sour dough"), ("a", 3, "x sour dough. SOUR"), ("a", 9, None), ("b", 1, "the"), ("b", 2, "Rye rye, Rye")], "book string, doc_pos long, text string").repartition(3)
    counted = terms.counts(docs)
    got = {(r["book"], r["n"], r["key"]): (r["surface"], r["cnt"], r["cap"], r["first"] and r["first"]["doc_pos"]) for r in counted.collect()}
    assert got[("a", 0, "")][1] == 8 and got[("b", 0, "")][1] == 4
    assert got[("a", 1, "sour")] == ("sour", 4, 0, 3) and got[("a", 2, "sour dough")] == ("sour dough", 3, 0, 3) and got[("b", 1, "rye")] == ("Rye", 3, 0, 2)
    assert ("b", 1, "the") not in got and got[("a", 3, "x sour dough")] == ("x sour dough", 1, 0, 3)
    plan = terms.counts(docs.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(key") == 1 and plan.count("ENSURE_REQUIREMENTS") == 0


def counted_here(pages, least=1, known=frozenset()):
    blocks = pa.Table.from_batches(list(terms._counted(True, known)(iter([pa.RecordBatch.from_pylist(pages)])))).sort_by("key")
    return sorted((tuple(r.values()) for b in terms._met(least)(iter(blocks.to_batches())) for r in b.to_pylist()), key=repr)


def test_rare_ngrams_go_early_and_hashes_that_meet_stay_apart(spark, monkeypatch):
    """Rare n-grams but known ones are left out, whatever the size of batches and parts, and keys of one hash are told apart."""
    pages = [{"book": b, "doc_pos": d, "text": t} for b, d, t in [("a", 7, "Sour Dough! sour dough, rye"), ("a", 3, "x sour dough. SOUR " + "oat. " * 9), (None, 9, "rye. rye"), ("b", None, "Rye; spelt rye. ..."), ("c", 1, "...")]]
    every = counted_here(pages)
    assert ("b", 2, "spelt rye", "spelt rye", 1, 0, None, 1) in every and (None, 1, "rye", "rye", 2, 0, 9, 0) in every and ("a", 0, "", "", 18, 0, None, None) in every
    strong = counted_here(pages, 2, frozenset(["spelt rye"]))
    assert strong == [r for r in every if r[4] >= 2 or r[2] in ("", "spelt rye")] and len(strong) < len(every)
    monkeypatch.setattr(terms, "WORDS", 3)
    monkeypatch.setattr(terms, "ROWS", 1)
    assert counted_here(pages) == every
    monkeypatch.setattr(terms, "_hashes", lambda values: np.zeros(len(values), np.uint64))
    assert counted_here(pages) == every and counted_here(pages, 2, frozenset(["spelt rye"])) == strong
    docs = spark.createDataFrame([(p["book"], p["doc_pos"], p["text"]) for p in pages], "book string, doc_pos long, text string")
    assert {r["key"] for r in terms.frequent(docs, spark.createDataFrame([("spelt rye",)], "form string")).collect()} == {"", "sour", "dough", "sour dough", "oat", "rye", "spelt rye"}
