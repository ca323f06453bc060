"""Words that meet in a polynomial modulo 2^64, whatever its base, stay apart."""

import pyarrow as pa

from quarry.llm import decontaminate, lm_scoring, near_dedup
from quarry.llm.common import LONG_WORD, word_hashes


def pair(n=2048):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_hashes_differ_by_every_byte():
    hashes, ends = word_hashes(pa.array([" ".join(pair(n)) for n in (64, 512, 1024, 2048, 4096)]))
    assert len(set(hashes.tolist())) == 10 and ends.tolist() == [0, 2, 4, 6, 8, 10]
    for n in (1, 7, 8, 9, 16, 17, LONG_WORD, LONG_WORD + 1):
        words = {"x" * n} | {"x" * i + "y" + "x" * (n - i - 1) for i in range(n)}
        hashes, _ = word_hashes(pa.array([" ".join(sorted(words))]))
        assert len(set(hashes.tolist())) == len(words)
    same, _ = word_hashes(pa.array(["Word", "a wORD b", None, "word\tword"]))
    assert len(set(same[[0, 2, 4, 5]].tolist())) == 1


def test_near_dedup_keeps_both(spark):
    rows = list(enumerate(pair(), 1))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in got} == {1: (1, True), 2: (2, True)}


def test_lm_knows_one_of_them_only(spark):
    from zlib import crc32

    learn, held = next(i for i in range(99) if crc32(str(i).encode()) % 10), next(i for i in range(99) if crc32(str(i).encode()) % 10 == 0)
    rows = [(learn, pair()[0]), (held, pair()[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.lm_scores(docs, docs.where(f"doc_id = {learn}")).collect()}
    assert got[held]["n_known"] == 1  # the end alone


def test_decontamination_does_not_match(spark):
    one, two = pair()
    docs = spark.createDataFrame([(1, " ".join([one] * 20)), (2, " ".join([two] * 20))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join([one] * 20))], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [2]
