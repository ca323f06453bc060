import random

import numpy as np
import pytest

from quarry.llm import decontaminate, line_dedup, sharding
from tests_shared import brute_lines

SCHEMA = "doc_id long, text string, lines_gone string, n_chars long"


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    lines = [" ".join(rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 2, 3, 6]))) for _ in range(12)]
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 14)))) for i in range(40)]
    docs += [(100, docs[0][1]), (101, "\n".join([lines[3]] * 9)), (102, ""), (103, "\n\n\n")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs] + [(200, None, "x", 1)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, min_words=8).collect()}
    want = brute_lines(docs, 8)
    texts = dict(docs)
    for i, gone in want.items():
        assert list(got[i]["lines_gone"] or []) == gone, i
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
        assert got[i]["n_lines_gone"] == len(gone)
    assert got[200]["text"] is None and len(got) == len(docs) + 1


def test_line_dedup_ties_and_empty(spark):
    long = " ".join(["w"] * 60)
    df = spark.createDataFrame([(5, long, "", 0), (5, long, "", 0), (9, long + "\nend", "", 0), (None, long, "", 0)], SCHEMA)
    got = sorted((r["doc_id"] or -1, r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(-1, ""), (5, long), (5, long), (9, "end")]
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_blank_heavy_texts(spark):
    text = "\n".join(x for _ in range(60) for x in ["a", *[""] * 60])
    df = spark.createDataFrame([(1, text, "", 0), (2, text, "", 0), (3, "x\n" * 3000, "", 0)], SCHEMA)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[2]["text"] == "" and got[2]["n_lines_gone"] == 60 * 61
    assert got[1]["text"] == "\n".join(text.split("\n")[: 61 * 60 - got[1]["n_lines_gone"]])
    assert 50 <= len(got[3]["text"].split()) < 110


def test_line_dedup_columns_of_the_new_names_and_hot_lines(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.common.HOT_ROWS", 2)
    docs = [(i, "\n".join(["common line here"] * 4 + [f"own {i % 7}"])) for i in range(30)]
    df = spark.createDataFrame([(i, t, "x", 5, 6, 7) for i, t in docs], "doc_id long, text string, lines_gone string, n_lines_gone int, _d int, _t int")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, min_words=8).collect()}
    assert {i: list(r["lines_gone"] or []) for i, r in got.items()} == brute_lines(docs, 8) and got[3]["_d"] == 6 and got[3]["_t"] == 7
    runs = line_dedup.repeated_runs(df, 8).collect()
    assert {(r["doc_id"], r["begin"], r["end"]) for r in runs} >= {(7, 0, 5), (29, 0, 5)} and len(runs) == len({r["doc_id"] for r in runs})


def items():
    rnd = random.Random(8)
    return [(i, " ".join(f"t{rnd.randrange(5000)}" for _ in range(n))) for i, n in enumerate([15, 20, 40, 60, 7, 1])]


def test_leaks_are_found_with_substitutions(spark):
    rnd = random.Random(9)
    bench = items()
    noise = lambda n: [f"n{rnd.randrange(9000)}" for _ in range(n)]
    docs, want = [], set()
    for k in range(40):
        item, text = bench[k % 5]
        w = text.split()
        for j in rnd.sample(range(len(w)), 2 if len(w) >= 15 else 0):
            w[j] = "changed"
        docs.append((k, " ".join(noise(rnd.randint(0, 80)) + w + noise(rnd.randint(0, 80))).upper(), "", 0))
        want.add((k, item))
    docs += [(500 + k, " ".join(noise(100)), "", 0) for k in range(30)] + [(600, None, "", 0), (601, "", "", 0), (602, "x" * 200_000, "", 0)]
    docs.append((603, " ".join(bench[2][1].split()[:9] + noise(50)), "", 0))
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    b = spark.createDataFrame([*bench, (50, None), (51, ""), bench[0]], "item_id long, text string")
    got = decontaminate.find_matches(df, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    kept = decontaminate.drop_contaminated(df, b)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, *_ in docs if i >= 500)


def test_leaks_in_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 40)
    bench = items()
    df = spark.createDataFrame([(i, f"a b {t} c", "", 0) for i, t in bench[:5]], SCHEMA)
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_matches(df, b).collect()} == {(i, i) for i in range(5)}
    assert decontaminate.find_matches(df.where("false"), b).count() == 0
    assert decontaminate.find_matches(df, b.where("false")).count() == 0


def test_differencing_is_consistent_and_tight():
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(1, 1000, 300)
    sums = []
    for s in sizes:
        v = np.zeros(7, np.int64)
        v[-1] = s
        sums.append(v)
    total, final = sharding.difference(sums)
    shards = np.bincount(final[:, -1], weights=sizes, minlength=7)
    assert sorted(shards.tolist()) == sorted(total.tolist()) and [shards[k] for k in range(7)] == total.tolist()
    assert total.max() - total.min() <= 3


@pytest.mark.parametrize("bucket_groups, fan_in", [(10_000, 4096), (7, 3)])
def test_shards(spark, monkeypatch, bucket_groups, fan_in):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", bucket_groups)
    monkeypatch.setattr(sharding, "FAN_IN", fan_in)
    rnd = random.Random(5)
    docs = [(i, rnd.choice(["é", "bc"]) * rnd.randint(0, 300), "", 0) for i in range(200)] + [(300, None, "", 0), (301, None, "", 0), (302, "", "", 0), (7, "dup", "", 0), (7, "dup", "", 0), (None, "n", "", 0)]
    out = sharding.shard(spark.createDataFrame(docs, SCHEMA), shards=5).collect()
    assert len(out) == len(docs)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(5))
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    sums = [sum(r["size"] for r in rs) for rs in by.values()]
    assert max(sums) - min(sums) < 0.05 * sum(sums) / 5
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    assert len({r["shard"] for r in out if r["doc_id"] in (300, 301)}) == 1
    assert next(r["size"] for r in out if r["doc_id"] == 300) == 16
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
