"""Queries do the whole job: whole tables, whole texts, every page and every count."""

import json
import zlib
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from quarry import plans
from quarry.operators import terms


def put(folder, name, rows, columns):
    """A table of a data folder."""
    pd.DataFrame(rows, columns=columns).to_parquet(f"{folder}/{name}.parquet")
    return str(folder)


def lines_of(text, width, font):
    lines = []
    for word in text.split():
        if lines and len(lines[-1] + " " + word) * 0.5 * font <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return lines


def test_wrap_fit_takes_long_documents(spark, tmp_path):
    texts = ["a bc " * 20, "word " * 1500, "w" * 200 + " x", "ab cde fgh " * 900, ""]
    sf = put(tmp_path, "documents", [(379 - 50 * i, t, len(t)) for i, t in enumerate(texts)], ["doc_id", "text", "n_chars"])
    got = {r["block"]: (r["fits"], r["scale"], r["lines"]) for r in plans.QUERIES["wrap_fit"](spark, sf).collect()}
    want = {}
    for i, t in enumerate(texts):
        height = (379 - 50 * i) % 400 + 20.0
        for k in range(16):
            scale = round(1.0 - 0.02 * k, 2)
            n = len(lines_of(t, 400.0, 10.0 * scale))
            if fits := n * 10.0 * scale * 1.2 <= height + 1e-6:
                break
        want[379 - 50 * i] = (fits, scale, n)
    assert got == want


TEXTS = ['say "hi" \\ there\n\ttab \x01 ' + "long " * 100 + 'end"', '\\"', "{}}, [", 'x": "y', "é 😀" * 60, "plain"]


def test_responses_hold_whole_texts(spark, tmp_path):
    rows = [(conv, turn, t) for conv in range(4) for turn, t in enumerate([*TEXTS, " \n\t", ""])]
    sf = put(tmp_path, "conversations", rows, ["conv_id", "turn", "text"])
    got = {(r["conv_id"], r["id"]): r["value"] for r in plans.QUERIES["json_strict_parse"](spark, sf).collect()}
    assert got == {(c, str(k)): t for c, k, t in rows if t.strip()}
    assert {r["conv_id"]: (r["expected"], r["missing"]) for r in plans.QUERIES["missing_ids"](spark, sf).collect()} == {c: (8, "6,7,999") for c in range(4)}
    got = {r["conv_id"]: (r["found"], r["strict_ids"], r["salvaged_ids"]) for r in plans.QUERIES["json_salvage"](spark, sf).collect()}
    whole = (6, "0,1,2,3,4,5", "")
    raw = json.dumps({str(k): t for c, k, t in rows if c == 1}, ensure_ascii=False)
    cut = raw[: int(len(raw) * 0.7)]
    kept = [str(k) for k, t in enumerate(TEXTS) if f'"{k}": {json.dumps(t, ensure_ascii=False)}' in cut]
    assert 0 < len(kept) < 6
    assert got == {0: whole, 1: (len(kept), "", ",".join(kept)), 2: whole, 3: whole}


def test_unit_assignment_has_every_page(spark, tmp_path):
    rows = [(k, n, 100.0, datetime(2024, 1, 1)) for k, n in enumerate([0, 1, 2, 19, 40, 50, 51, 81, 137, 399])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["job_id"], r["page"]): r["chunk_index"] for r in plans.QUERIES["unit_assignment"](spark, str(tmp_path)).collect()}
    assert got == {(k, p): 0 if n <= 50 else (p - 1) // 40 for k, n, *_ in rows for p in range(1, n + 1)}


def test_ngram_counts_have_rare_ones(spark, tmp_path):
    sf = put(tmp_path, "documents", [(1, "s", "en", "Amber basin. Amber crane"), (2, "s", "en", "amber; crane of basin")], ["doc_id", "source", "lang", "text"])
    got = {r["key"]: (r["n"], r["cnt"], r["surface"], r["first_doc"]) for r in plans.QUERIES["ngram_counts"](spark, sf).collect()}
    assert got == {
        "amber": (1, 3, "Amber", 1), "basin": (1, 2, "basin", 1), "crane": (1, 2, "crane", 1), "amber basin": (2, 1, "Amber basin", 1), "amber crane": (2, 1, "Amber crane", 1),
        "crane of basin": (3, 1, "crane of basin", 2),
    }


def test_terms_are_folded(spark, tmp_path):
    text = "\ufb01lter \ufb02our. caf\u0065\u0301 brul\u00e9e. \uff46\uff55\uff4c\uff4c. o\ufb00er plain"
    sf = put(tmp_path, "documents", [(k, "s", "en", t) for k, t in enumerate([text, text, "Plain \u2018ASCII\u2019 na\u00efve", None])], ["doc_id", "source", "lang", "text"])
    counts = {r["key"]: r["cnt"] for r in plans.QUERIES["ngram_counts"](spark, sf).collect()}
    assert {k: counts.get(k) for k in ("filter flour", "caf\u00e9 brul\u00e9e", "full", "offer", "plain", "na\u00efve")} == {"filter flour": 2, "caf\u00e9 brul\u00e9e": 2, "full": 2, "offer": 2, "plain": 3, "na\u00efve": 1}
    assert {"filter flour", "full", "offer plain"} <= {r["match_key"] for r in plans.QUERIES["term_candidates"](spark, sf).collect()}
    assert {r["doc_pos"]: r["tokens"] for r in plans.QUERIES["tokenize_segments"](spark, sf).collect()} == {0: 7, 1: 7, 2: 3}


def test_terms_are_ranked_once_for_a_refresh(spark, tmp_path):
    sf = put(tmp_path, "documents", [(k, "s", "en", "amber basin; Amber; crane") for k in range(3)], ["doc_id", "source", "lang", "text"])
    found = {r["match_key"]: r["occurrences"] for r in plans.QUERIES["term_candidates"](spark, sf).collect()}
    out = plans.QUERIES["term_refresh"](spark, sf)
    assert out.inputFiles() and all("/found-" in f for f in out.inputFiles())  # not what candidates are ranked from
    got = {r["term"]: (r["status"], r["occurrences"]) for r in out.collect()}
    decided = {t for t in found if " " not in t and zlib.crc32(t.encode()) % 3 == 0}
    assert {"amber basin", "amber", "crane"} == set(found) and got == {t: ("dismissed", 0) if t in decided else ("pending", n) for t, n in found.items()}


def test_a_refresh_has_every_candidate(spark, tmp_path):
    words = ["q" + "".join("abcdefghijkmnoprtuvz"[i // 20**k % 20] for k in range(4)) for i in range(20_003)]
    sf = put(tmp_path, "documents", [(k, "s", "en", "; ".join(words)) for k in range(2)], ["doc_id", "source", "lang", "text"])
    got = {r["term"]: (r["status"], r["occurrences"]) for r in plans.QUERIES["term_refresh"](spark, sf).collect()}
    assert got == {w: ("dismissed", 0) if zlib.crc32(w.encode()) % 3 == 0 else ("pending", 2) for w in words}


def test_ranks_have_every_candidate_unless_capped(spark):
    few = spark.createDataFrame([("b", 1, f"w{k}", f"w{k}", k + 1, []) for k in range(20_003)], "book string, n int, key string, surface string, cnt long, flags array<string>")
    assert terms.ranked(few).agg(F.count("*"), F.max("place")).collect() == [(20_003, 20_003)]
    assert sorted((r["match_key"], r["place"]) for r in terms.ranked(few, 2).collect()) == [("w20001", 2), ("w20002", 1)]


def test_prompt_variants_and_payloads(spark):
    import json

    from quarry.functions import lexicon
    from quarry.operators import records

    parts = {"intro": "From {lang}", "instruction": "Terms", "no_glossary": "none", "rules": "Rules", "footer": "X ${text}"}
    df = spark.createDataFrame([("| $5 |", "a CUP of", "fr"), ("", "plain", None), (None, None, "de")], "g string, s string, lang string")
    made = lambda v, **k: [r[0] for r in df.select(records.prompt_variant(v, parts, F.col("g"), **k)).collect()]
    unit = records.unit_section()
    assert all(w in unit for _, w in lexicon.CUP_WEIGHTS) and "$" not in unit
    assert made("plain", source=F.col("s"), lang=F.col("lang")) == [f"From fr\n\nTerms\n\n| $5 |\n\n{unit}\n\nRules", "From en\n\nnone\n\nRules", f"From de\n\nnone\n\n{unit}\n\nRules"]
    assert made("template", source=F.col("s"))[0] == f"From en\n\nTerms\n\n| $$5 |\n\n{unit}\n\nRules\n\nX ${{text}}"
    assert made("system")[1] == f"From en\n\nnone\n\n{unit}\n\nRules"
    with pytest.raises(ValueError, match="place for the text"):
        records.prompt_variant("template", {**parts, "footer": "X"}, F.col("g"))
    with pytest.raises(ValueError, match="no such variant"):
        records.prompt_variant("other", parts, F.col("g"))
    texts = [['a "q" \\ é\n\t', "", None], []]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t array<string>").select(records.payload(F.col("t"))).collect()]
    assert got == [json.dumps([{"id": str(i), "html": x or ""} for i, x in enumerate(t)], ensure_ascii=False) for t in texts]


def test_chunks_hold_their_pages(spark):
    from quarry.operators import records

    pages = spark.createDataFrame([(1, p, None if p == 3 else f"p{p}\n ") for p in range(1, 91)] + [(2, 1, " ")], "job_id long, page long, text string")
    chunks = spark.createDataFrame([(1, 0, 1, 40), (1, 1, 39, 80), (1, 2, 79, 90), (2, 0, 1, 5), (3, 0, 1, 5)], "job_id long, chunk_index int, page_start int, page_end int")
    got = {(r["job_id"], r["chunk_index"]): r for r in records.chunk_texts(pages, chunks).collect()}
    assert {k: (r["pages"], r["segments"]) for k, r in got.items()} == {(1, 0): (40, 39), (1, 1): (42, 42), (1, 2): (12, 12), (2, 0): (1, 1)}
    assert got[1, 2]["text"] == "\n".join(f"p{p}\n " for p in range(79, 91)) and got[1, 0]["text"].startswith("p1\n \np2\n \n\np4")
