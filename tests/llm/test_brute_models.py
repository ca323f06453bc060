"""The lexicon's matches against a search at every place, and differencing against a plain one."""

import random

import numpy as np
import pytest

from quarry.llm import sharding, toxicity


@pytest.mark.parametrize("seed", range(5))
def test_matches_equal_a_search_at_every_place(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abc", k=rnd.randrange(1, 5)))
    weights = {f" {word()}{rnd.choice(['', ' '])}": rnd.randrange(1, 9) + rnd.random() for _ in range(9)} | {f"# {word()}": rnd.randrange(1, 9) + rnd.random() for _ in range(4)}
    model = toxicity.Lexicon(weights, [f" {word()} {word()} " for _ in range(6)], threshold=1.0)
    assert (toxicity.DENSE, toxicity.DENSE_LEAST) == (13, 3)
    automaton = model.automaton()
    for _ in range(60):
        folded = toxicity.fold(" ".join(word() for _ in range(rnd.randrange(0, 30))))
        spared = [(a, a + len(p) - 1) for p in model.exceptions for a in range(len(folded)) if folded.startswith(p, a)]
        total = 0.0
        often = {e: sum(folded.startswith(e[1:], a) for a in range(len(folded))) for e in weights if e[0] == "#"}
        count = {e: n >= 3 and 1000 * n >= 13 * (folded.count(" ") + 20) for e, n in often.items()}
        for a in range(len(folded)):
            found = [(w, a + len(e.lstrip("#")) - 1) for e, w in weights.items() if count.get(e, True) and folded.startswith(e.lstrip("#"), a)]
            if found:
                w, b = max(found)
                total += 0 if any(x <= a and b <= y for x, y in spared) else w
        assert model.feature(folded, automaton) == pytest.approx(np.log1p(1000 * total / (folded.count(" ") + 20)))


def test_folding_meets_written_around_letters():
    assert toxicity.fold("H3llo WÖRLD") == toxicity.fold("hello w0rld") and toxicity.fold("bаd") == toxicity.fold("bad") and toxicity.fold(None) == toxicity.fold("") == "  "


def plain_differencing(sizes, k):
    """Final sums: the two partial partitions of the largest spread are added, the greatest sums of one to the least of the other."""
    parts = [[0] * (k - 1) + [s] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b))))
    return parts[0]


@pytest.mark.parametrize("k, n", [(2, 30), (5, 80), (40, 200)])
def test_differencing_equals_a_plain_one(spark, k, n):
    rnd = random.Random(k)
    sizes = [rnd.randrange(10**13, 10**15) for _ in range(n)]  # no two spreads are equal
    rows = [(i.to_bytes(4, "big"), s) for i, s in enumerate(sizes)]
    found = sharding.shard_groups(spark.createDataFrame([(bytearray(g), s) for g, s in rows], "gid binary, size long"), k).collect()
    by_shard = [0] * k
    for r in found:
        by_shard[r["shard"]] += dict(rows)[bytes(r["gid"])]
    assert sorted(by_shard) == plain_differencing(sizes, k)
    total, final = sharding.difference([np.array([0] * (k - 1) + [s % 2**40], dtype=np.int64) for s in sizes])
    want = plain_differencing([s % 2**40 for s in sizes], k)
    sums = [0] * k
    for s, places in zip(sizes, final):
        sums[places[-1]] += s % 2**40
    assert sorted(total.tolist()) == want == sorted(sums)


def test_a_group_larger_than_a_shard_fills_one(spark):
    docs = spark.createDataFrame([(i, "x" * 5000) for i in range(9)] + [(100 + i, f"{i}" * 50) for i in range(60)], "doc_id long, text string")
    rows = sharding.shard(docs, shards=4).collect()
    big = {r["shard"] for r in rows if r["doc_id"] < 9}
    assert len(big) == 1 and not any(r["shard"] in big for r in rows if r["doc_id"] >= 100)
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
