import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests_shared import brute_lines, brute_near  # noqa: E402

WORDS = {"en": [f"the{x}ing" for x in "abcdefghijklmnop"], "fr": [f"étaux{x}eur" for x in "abcdefghijklmnop"]}


def corpus():
    rnd = random.Random(6)
    rows = []
    for i in range(120):
        lang = rnd.choice(["en", "fr"])
        lines = [" ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(4, 20))) for _ in range(rnd.randint(1, 8))]
        rows.append((i, "\n".join(lines), lang, f"s{i % 3}", 0))
    long = " ".join(rnd.choice(WORDS["en"]) for _ in range(70))
    rows += [(200, rows[3][1], rows[3][2], "s", 0), (201, long + "\nand more words here", "en", "s", 0), (202, long + "\nother words stand there", "en", "s", 0), (203, None, None, "s", 0), (204, "1234 !!", None, None, 0), (205, "日本語の文章です" * 30, None, "s", 0)]
    near = rows[10][1].split()
    rows.append((206, " ".join([*near[:-1], "changed"]), rows[10][2], "s", 0))
    leak = " ".join(f"t{rnd.randrange(900)}x" for _ in range(30))
    rows.append((207, f"{rows[20][1]} {leak}", rows[20][2], "s", 0))
    rows.append((207, f"{rows[20][1]} {leak}", rows[20][2], "s", 0))
    return rows, [(1, leak), (2, "never seen words of a benchmark item that nobody has copied into the documents at all")]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    from quarry.llm.bpe import load_ranks

    rows, bench = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = {i: t for i, t, *_ in rows if i not in (203, 204, 205)}
    gone = brute_lines(sorted(want.items()), 50)
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in want.items()}
    want = {i: t for i, t in left.items() if t or not gone[i]}
    want = {i: t for i, t in want.items() if brute_near(sorted(want.items()))[i][1] == i}
    want = {i: t for i, t in want.items() if bench[0][1] not in t}
    assert 200 not in want and 206 not in want and 207 not in want and 202 in want

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in got:
        ids = library.encode_ordinary(want[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    rows, bench = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        empty = stage(spark, docs.where("false"), str(tmp_path))
        assert empty.dtypes == docs.dtypes and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0
