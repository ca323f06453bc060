import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_id


def word(k):
    return f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k * 7 % 26)}qz"


def test_every_language_can_be_predicted(spark):
    """Seventy languages, each with words of its own."""
    rows = [(10 * k + i, f"{word(k)} " * (20 + i), f"l{k:02d}") for k in range(70) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.langs == [f"l{k:02d}" for k in range(70)]
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where(F.col("lang_pred") == F.col("lang")).count() == len(rows)


def test_the_driver_gets_centroids_only(spark):
    """Two hundred languages of 300 rows: rows of grams would be 490 MB; no result of more than 20 MB goes to the driver."""
    n = 200
    names = F.array(*(F.lit(word(k)) for k in range(n)))
    docs = spark.range(300 * n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.repeat(F.concat(F.get(names, (F.col("id") % n).cast("int")), F.lit(" ")), 12), F.col("id").cast("string")).alias("text"), (F.col("id") % n).cast("string").alias("lang"))
    before = spark.conf.get("spark.driver.maxResultSize", "1g")
    got = language_id.train(docs, sample=300)
    assert len(got.langs) == n and got.centroids.shape[0] <= n * language_id.CENTROIDS and before
    assert sum(x.nbytes for x in (got.centroids, got.idf, got.near, got.owner)) < 30 << 20
    lang, _, _ = got.predict(pa.array([f"{word(k)} " * 12 for k in range(0, n, 9)]))
    assert lang == [str(k) for k in range(0, n, 9)]


@pytest.mark.parametrize("seed", [0, 1])
def test_prediction_equals_brute_force(spark, seed):
    """Cosine of every text to every centroid, gram by gram in Python."""
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("abcdeé Z9"), 40)) for _ in range(20)] + ["", None, "77"]
    docs = spark.createDataFrame([(i, "".join(rng.choice(list("abcdeé "), 60)), f"l{i % 3}") for i in range(60)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    lang, score, _ = model.predict(pa.array(texts, pa.string()))
    for text, one, like in zip(texts, lang, score):
        if not language_id.has_letter(text):
            assert (one, like) == ("und", 0.0)
            continue
        kept = []  # letters as they are, lower-cased; all else one blank after a run of letters
        for b in (text or "").encode():
            b = b + 32 if 65 <= b <= 90 else b
            if 97 <= b <= 122 or b >= 128:
                kept.append(b)
            elif kept and kept[-1] != 32:
                kept.append(32)
        counts = np.zeros(language_id.DIMS)
        for k, factor in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
            for i in range(len(kept) - k + 1):
                value = 0
                for b in kept[i : i + k]:
                    value = (value * 257 + b) % 2**32
                counts[(value * factor % 2**32) >> 21] += 1
        v = np.log1p(counts) * model.idf
        cosines = [float(v @ c) / (float(np.linalg.norm(v)) or 1) for c in model.centroids]
        assert abs(max(cosines) - like) < 1e-5 and cosines[[model.langs[o] for o in model.owner].index(one)] > -1
        assert max(c for c, o in zip(cosines, model.owner) if model.langs[o] == one) > max(cosines) - 1e-5
