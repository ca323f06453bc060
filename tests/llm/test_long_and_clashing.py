"""Very long texts, with and without blanks, ties, and columns called like those of the operators."""

from pyspark.sql import functions as F

from quarry.llm import language_id, line_dedup, near_dedup

NAMES = "n_shingles component_id kept sha sig key part a b n lang_pred score rejected h rn size line pos rank n_lines_gone lines_gone gid batch i".split()


def clashing(spark, rows, columns):
    df = spark.createDataFrame(rows, columns)
    return df.select("*", *(F.lit("x").alias(c) for c in NAMES if c not in df.columns)).repartition(3)


def test_near_copies_of_very_long_texts(spark):
    words = [f"w{i * 7919 % 50021}" for i in range(120_000)]
    edited = words.copy()
    edited[::50] = ["edit"] * len(edited[::50])  # nine of ten shingles stay
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, "q" * 1_500_000), (4, "q" * 1_500_000), (5, "other words stand here now")]
    df = clashing(spark, rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (3, False), 5: (5, True)}
    left = near_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.select("doc_id").collect()} == {1, 3, 5}


def test_languages_of_very_long_texts_and_ties(spark):
    rows = [(i, f"{'abc' if i % 2 else 'xyz'} " * (10 + i), "one" if i % 2 else "two") for i in range(60)]
    rows += [(100, "same text here", "one"), (101, "same text here", "two")]  # equally near to both
    df = clashing(spark, rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    long = clashing(spark, [(1, "abc " * 400_000), (2, "xyz" * 400_000), (3, "same text here"), (4, "same text here"), (5, "7" * 1_000_000), (6, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(long, model).collect()}
    assert got[1] == "one" and got[2] == "two" and got[3] == got[4] and got[5] == got[6] == "und"
    kept = language_id.filter_language(long, model)
    assert kept.columns == long.columns and {5, 6}.isdisjoint(r["doc_id"] for r in kept.select("doc_id").collect())
    assert language_id.identify(long.limit(0), model).count() == 0


def test_lines_of_very_long_texts(spark):
    line, passage = "z" * 1_200_000, "\n".join(f"line {i} of a passage that comes twice" for i in range(2000))
    rows = [(1, line), (2, line + "\nown line"), (3, passage + "\nends here"), (4, "begins here\n" + passage), (5, None)]
    df = clashing(spark, rows, "doc_id long, text string")
    out = line_dedup.dedup_lines(df)
    got = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
    assert got == {1: line, 2: line + "\nown line", 3: rows[2][1], 4: "begins here", 5: None}  # a word, however long, is no run of fifty
