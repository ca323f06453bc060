"""Cases that the operators' docstrings define: null ids, repeated rows, clashing columns, ties, very long texts, empty tables."""

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers as P  # noqa: E402

from quarry.llm import bpe, decontaminate, exact_dedup, lm_scoring, sharding, token_counts, toxicity  # noqa: E402

LONG = "alpha beta gamma delta " * 60_000
ROWS = [(1, "some words stand here"), (1, "some words stand here"), (None, "some words stand here"), (None, None), (2, ""), (3, LONG)]
NAMES = "n_tokens n_bytes ids_sha256 over_limit score predicted shard slot size gid keep_id sha kept group_size h part key"


@pytest.fixture(scope="module")
def docs(spark):
    clash = NAMES.split()
    rows = [(*r, *["x"] * len(clash)) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash)).repartition(3)


def test_round_trip_of_defined_cases(docs):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.bpe_roundtrip(docs, path, P.PATTERN).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS)
    same = {(r["n_tokens"], r["ids_sha256"]) for r in rows if r["doc_id"] == 1}
    assert len(same) == 1 and sum((r["n_tokens"], r["ids_sha256"]) in same for r in rows) == 3
    assert sorted(r["n_tokens"] for r in rows if r["doc_id"] in (None, 2))[:2] == [0, 0]
    assert bpe.bpe_encode(docs.where("false"), path, P.PATTERN).count() == 0


def test_counts_of_defined_cases(docs):
    rows = token_counts.token_counts(docs, P.path("word_bpe_49k.json")).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS)
    assert Counter(r["n_bytes"] for r in rows) == Counter(len((t or "").encode()) for _, t in ROWS)
    assert [r["over_limit"] for r in rows if r["doc_id"] == 3] == [True]


def test_exact_copies_of_defined_cases(docs):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS)
    by_sha = {}
    for r in rows:
        by_sha.setdefault(r["text_sha256"], []).append(r)
    assert sorted(len(g) for g in by_sha.values()) == [1, 2, 3] and all({r["group_size"] for r in g} == {len(g)} for g in by_sha.values())
    # rows that repeat id and text are one document, and a row without an id never stays beside one that has an id
    assert Counter(r["doc_id"] for r in rows if r["kept"]) == {1: 2, 2: 1, 3: 1}


def test_shards_of_defined_cases(docs):
    rows = sharding.shard(docs, 3).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS)
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 16 for _, t in ROWS)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    large = next(r["shard"] for r in rows if r["doc_id"] == 3)
    assert all(r["shard"] != large for r in rows if r["doc_id"] != 3)  # a group larger than a shard stands alone
    assert len({r["shard"] for r in rows if r["size"] == len(ROWS[0][1]) + 16}) == 1  # equal texts stay together


def test_language_model_on_defined_cases(docs):
    rows = lm_scoring.lm_scores(docs, docs.where("doc_id = 1 or doc_id is null")).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS)
    assert sorted(r["n_tokens"] for r in rows) == sorted(len((t or "").split()) + 1 for _, t in ROWS)
    assert all(r["score"] <= 0 and r["base_score"] <= 0 for r in rows) and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1


def test_toxicity_of_defined_cases(spark, docs):
    teach = [(i, f"{'vile nasty' if i % 2 else 'fine nice'} word{i % 7} text{i % 5}") for i in range(200)]
    labels = [(i, i % 2) for i in range(200)] + [(1, 1), (900, 1)]
    lexicon = toxicity.train(spark.createDataFrame([*teach, *teach[:5], (None, "vile")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    long = "fine nice words " * 50_000
    extra = [(10, "vile nasty"), (11, long), (11, long), (12, None), (None, "vile nasty")]
    rows = toxicity.score_texts(spark.createDataFrame(extra, "doc_id long, text string").unionByName(docs.select("doc_id", "text")), lexicon).collect()
    assert len(rows) == len(extra) + len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert sorted((r["doc_id"] or 0, r["predicted"]) for r in rows if r["predicted"]) == [(0, 1), (10, 1)]
    assert toxicity.score_texts(docs, lexicon).count() == len(ROWS)


def test_leaks_of_defined_cases(spark, docs):
    item = " ".join(f"w{i}" for i in range(20))
    extra = [(20, f"before {item} after"), (20, f"before {item} after"), (None, item), (21, f"{item} {LONG} {item}")]
    both = spark.createDataFrame(extra, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame([(5, item, 1), (5, item, 1), (6, None, 1), (7, "", 1)], "item_id long, text string, doc_id int")
    found = decontaminate.find_matches(both, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["n_agree"], r["doc_begin"]) for r in found) == [(0, 5, 20, 0), (20, 5, 20, 1), (20, 5, 20, 1), (21, 5, 20, 0)]
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.dtypes == docs.dtypes and left.count() == len(ROWS)
