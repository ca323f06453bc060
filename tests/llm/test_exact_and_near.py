import collections
import random

import numpy as np
import pytest

from quarry.llm import exact_dedup, near_dedup
from quarry.llm.common import word_hashes
from tests_shared import brute_near

SCHEMA = "doc_id long, text string, kept string, score int"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("n, span", [(0, 100), (1, 1 << 40), (500, 600), (3000, 1 << 36)])
def test_golomb_round_trip(n, span):
    values = np.unique(np.random.default_rng(n).integers(0, span, n))
    k, code = exact_dedup.golomb_encode(values, span)
    assert exact_dedup.golomb_decode(code, k, len(values)).tolist() == values.tolist()


def test_exact_groups_with_nulls_ties_and_clashing_columns(spark):
    data = [(1, "a", "x", 1), (2, "a", "x", 1), (3, None, "x", 1), (4, "", "x", 1), (5, "b", "x", 1), (7, "c", "x", 1), (7, "c", "x", 1), (None, "d", "x", 1), (9, "d", "x", 1), (10, "A", "x", 1)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    out = exact_dedup.exact_dedup(df, owners=3).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out if r["doc_id"] is not None) == [
        (1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (7, 7, 2, True), (7, 7, 2, True), (9, 9, 2, True), (10, 10, 1, True),
    ]
    (null,) = [r for r in out if r["doc_id"] is None]
    assert (null["keep_id"], null["kept"]) == (9, False)
    assert all(len(r["text_sha256"]) == 64 for r in out)


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def corpus(n=160, seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    common = [rnd.choice(vocabulary) for _ in range(40)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))] for _ in range(30)]
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        if rnd.random() < 0.3:
            w = common + w[: rnd.randint(1, 30)]
        out.append((i * 3 + 1, " ".join(w)))
    return out + [(1000, ""), (1001, None), (1002, " \n "), (1003, "one two"), (1004, "One  two"), (1005, "x" * 300_000)]


def test_near_duplicates_equal_brute_force(spark):
    data = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in data], SCHEMA).repartition(3)
    got = rows(near_dedup.near_duplicates(df))
    want = brute_near(data)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_null_ids_repeats_and_empty(spark):
    text = "a b c d e f g h"
    out = near_dedup.near_duplicates(spark.createDataFrame([(5, text, "", 0), (5, text, "", 0), (None, text, "", 0), (8, text, "", 0)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in out) == [(-1, None, True), (5, 5, True), (5, 5, True), (8, 5, False)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_drop_near_duplicates_keeps_columns(spark):
    df = spark.createDataFrame([(5, "a b c d e f", "k", 1), (6, "A b c d e f", "k", 2), (7, None, "k", 3)], SCHEMA)
    out = near_dedup.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [5, 7]


def test_posterior_bounds_rise_and_spare_similar_pairs():
    bounds = near_dedup.least_matches(0.75)
    assert [n for n, _ in bounds] == list(range(16, 129, 16))
    assert all(m < 0.75 * n for n, m in bounds)
    a = np.random.default_rng(1).integers(0, 1 << 32, (50, 128)).astype(np.uint32)
    b = a.copy()
    b[:, ::5] += 1
    assert len(near_dedup.survivors(a, b, 0.75)) == 50
    assert len(near_dedup.survivors(a, a[::-1].copy(), 0.75)) == 0


def test_word_hashes_follow_the_pattern():
    import re

    import pyarrow as pa

    texts = ["", None, " a\tB \x0b\x0cc", "é É", "x" * 2_100_000 + " y", "A\x1cb"]
    hashes, ends = word_hashes(pa.array(texts, pa.string()))
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(fold)) for t in texts]
    assert np.diff(ends).tolist() == [len(w) for w in words]
    seen = collections.defaultdict(set)
    for w, h in zip((w for ws in words for w in ws), hashes.tolist()):
        seen[h].add(w)
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len({w for ws in words for w in ws})


def test_near_repeated_id_with_other_text_is_one_document(spark, monkeypatch):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    data = [(1, a), (1, b), (2, a), (3, b), (4, b + " more"), (5, ""), (5, a + " more"), (None, a)]
    want = None
    for parts, hot in ((1, 200), (2, 1), (7, 1)):
        monkeypatch.setattr("quarry.llm.common.HOT_ROWS", hot)
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(parts, "text")
        got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in near_dedup.near_duplicates(df).collect())
        want = want or got
        assert got == want
    component = {i: c for i, _, c, _ in want}
    assert sum(x[0] == 1 for x in want) == 2 and component[4] == component[3] and component[2] == component[5]
    assert (component[1] == component[2]) != (component[1] == component[3])


def test_near_bucket_of_many_documents_with_common_words(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rnd = random.Random(1)
    common = [f"c{i}" for i in range(60)]
    data = [(i, " ".join(common + [f"x{rnd.randrange(10**6)}" for _ in range(40)])) for i in range(120)]
    data += [(200 + i, data[i][1] + " tail") for i in range(0, 120, 10)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_near(data)
