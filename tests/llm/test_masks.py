"""Every passage that verification accepts holds a seed."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontaminate


@pytest.mark.parametrize("size, changed", [(11, 0), (12, 0), (13, 1), (14, 2), (15, 3), (16, 4), (17, 4), (20, 5), (24, 6), (28, 7)])
def test_masks_meet_all_patterns(size, changed):
    left = np.fromiter((sum(1 << i for i in c) for c in itertools.combinations(range(size), changed)), np.uint32)
    for m in decontaminate.MASKS:
        reads = sum(1 << i for i, c in enumerate(m) if c == "1")
        for k in range(size - len(m) + 1):
            left = left[(left & np.uint32(reads << k)) != 0]
    assert not len(left)


@pytest.mark.parametrize("size, changed", [(15, 3), (16, 4), (17, 4)])
def test_edited_short_items_are_found(size, changed):
    item = [f"t{k}" for k in range(size)]
    texts = [" ".join(["before", *("x" if i in gone else w for i, w in enumerate(item)), "after"]) for gone in itertools.combinations(range(size), changed)]
    found = decontaminate.Block.of([5], [" ".join(item)]).matches(pa.array(texts))
    assert {m[0] for m in found} == set(range(len(texts)))


def test_words_that_come_again_and_again():
    import time

    items = [" ".join(["w"] * 5000), " ".join(["w"] * 30 + ["x"] * 30), " ".join(f"t{k}" for k in range(30))]
    texts = [" ".join(["w"] * 20_000), " ".join(["w"] * 4000 + ["x"] * 4000), " ".join(["y"] * 3000 + [f"t{k}" for k in range(30)] * 2), "w w w"]
    block, began = decontaminate.Block.of([1, 2, 3], items), time.perf_counter()
    found = {m[:2]: m[2:] for m in block.matches(pa.array(texts))}
    assert time.perf_counter() - began < 30
    assert found[0, 0] == (0, 5000, 5000) and found[1, 1] == (3970, 4030, 60)
    assert found[2, 2] == (3000, 3030, 30) and found[1, 0][2] == 4000 and {t for t, _ in found} == {0, 1, 2}


def brute_overlaps(text, item):
    """Whether some alignment holds a stretch with enough agreeing words."""
    t, w = text.split(), item.split()
    for shift in range(1 - len(w), len(t)):
        lo, hi = max(0, -shift), min(len(w), len(t) - shift)
        same = [t[j + shift] == w[j] for j in range(lo, hi)]
        if sum(same) < min(decontaminate.AGREE, len(w)):
            continue
        if len(w) < decontaminate.SPAN:
            return True
        stretches = list(itertools.combinations(range(len(same) + 1), 2))
        value = {(a, b): 3 * sum(same[a:b]) - 2 * (b - a) for a, b in stretches}
        best = [x for x in stretches if value[x] == max(value.values())] + [(0, len(same))]
        if any(sum(same[a:b]) >= max(min(decontaminate.AGREE, len(w)), decontaminate.SHARE * (b - a)) for a, b in best):
            return True
    return False


def test_matches_equal_brute_force():
    import random

    rnd = random.Random(3)
    items = [" ".join(rnd.choice("abcdefgh") * 2 for _ in range(n)) for n in (5, 11, 15, 18, 22)]
    texts = []
    for _ in range(60):
        w = items[rnd.randrange(5)].split()
        for j in rnd.sample(range(len(w)), rnd.randint(0, 3) if len(w) > 11 else 0):
            w[j] = "zz"
        texts.append(" ".join([rnd.choice("ijkl") for _ in range(rnd.randint(0, 9))] + w + [rnd.choice("ijkl") for _ in range(rnd.randint(0, 9))]))
    texts += [" ".join(rnd.choice("abcdefgh") * 2 for _ in range(25)) for _ in range(30)] + ["", "aa"]
    found = {(t, i) for t, i, *_ in decontaminate.Block.of(list(range(5)), items).matches(pa.array(texts))}
    assert found == {(t, i) for t, text in enumerate(texts) for i, item in enumerate(items) if brute_overlaps(text, item)}
