import math
import random
import zlib
from collections import Counter

import pytest

from quarry.llm import language_id, lm_scoring, toxicity

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"en": ["the", "with", "house", "thing", "other", "water"], "fr": ["les", "avec", "maison", "chose", "autre", "été"], "de": ["und", "schön", "haus", "ding", "andere", "wasser"]}


def texts(n=240, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(8, 60))), lang) for i in range(n) for lang in [rnd.choice(sorted(WORDS))]]


def test_language_of_held_out_texts(spark):
    data = [(i, t, lang, "s") for i, t, lang in texts()]
    df = spark.createDataFrame(data, SCHEMA)
    model = language_id.train(df.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in language_id.identify(df.where("doc_id % 2 = 1"), model).collect()}
    right = sum(got[i]["lang_pred"] == lang for i, _, lang, _ in data if i % 2)
    assert right / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 and not r["rejected"] for r in got.values())


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in texts()], SCHEMA)
    model = language_id.train(df)
    odd = spark.createDataFrame([(1, None, None, ""), (2, "", None, ""), (3, "12 $% —", None, ""), (4, "日本語のテキスト" * 40, None, ""), (5, "the " * 300_000, None, ""), (6, "с водой", None, "")], SCHEMA)
    got = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[4]["rejected"] and got[4]["lang_pred"] != "und"
    assert got[5]["lang_pred"] == "en" and got[6]["lang_pred"] in WORDS
    kept = language_id.filter_language(odd, model)
    assert kept.columns == odd.columns and 5 in {r["doc_id"] for r in kept.collect()}
    none = language_id.train(df.where("false"))
    assert {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(df.where("false"), model).count() == 0


def test_language_short_junk_is_rejected_and_short_texts_are_not(spark):
    data = texts(400)
    df = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in data], SCHEMA)
    model = language_id.train(df)
    odd = spark.createDataFrame([(1, "日本語", None, ""), (2, "ШЩ", None, ""), (3, "with the house", None, ""), (4, "avec les", None, ""), (None, "und schön", None, ""), (4, "avec les", None, "")], SCHEMA)
    got = [(r["doc_id"], r["lang_pred"], r["rejected"]) for r in language_id.identify(odd, model).collect()]
    assert sorted((i or 9, lang, r) for i, lang, r in got if i not in (1, 2)) == [(3, "en", False), (4, "fr", False), (4, "fr", False), (9, "de", False)]
    assert all(r for i, _, r in got if i in (1, 2))


def test_language_many_labels_of_one_language_and_repeated_ids(spark):
    data = [(i, f"the other water thing {i}", "en", "s") for i in range(3000)] + [(1, "with house", "en", "s")] * 50 + [(5000 + i, "les avec maison", "fr", "s") for i in range(30)]
    df = spark.createDataFrame(data, SCHEMA)
    sample = language_id._sample(df, "doc_id", "text", "lang", 40).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in sample} == {"en": 40, "fr": 30}
    first = sorted(r["text"] for r in language_id._sample(df, "doc_id", "text", "lang", 40).collect())
    assert first == sorted(r["text"] for r in language_id._sample(df.repartition(5), "doc_id", "text", "lang", 40).collect())


def toxic_corpus(n=300):
    rnd = random.Random(4)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randint(20, 200))]
        bad = rnd.random() < 0.3
        for _ in range(3 if bad else 0):
            w[rnd.randrange(len(w))] = rnd.choice(["nastyword", "vileness", "vilest"])
        if not bad and rnd.random() < 0.2:
            w += ["so", "called", "nastyword", "remover"]
        docs.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_learns_folds_and_spares(spark):
    docs, labels = toxic_corpus()
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.train(df.where("doc_id % 3 > 0"), lab)
    got = {r["doc_id"]: r for r in toxicity.score_texts(df, lexicon).collect()}
    assert sum(got[i]["predicted"] == y for i, y in labels) / len(labels) > 0.97
    odd = [(1, None), (2, ""), (3, "what a V1LENE$S here"), (4, "pure vіlest thing"), (5, "wordaa wordbb"), (6, "so called nastyword remover wordaa")]
    out = {r["doc_id"]: r for r in toxicity.score_texts(spark.createDataFrame(odd, "doc_id long, text string"), lexicon).collect()}
    assert [out[i]["predicted"] for i in range(1, 7)] == [0, 0, 1, 1, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(20)
    df = spark.createDataFrame(docs, SCHEMA)
    nothing = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score_texts(df, nothing).collect()} == {0.0}
    assert toxicity.score_texts(df.where("false"), nothing).count() == 0


def test_folding():
    assert toxicity.fold("Ïdi0t") == toxicity.fold("idiot") == toxicity.fold("1DIOT") == toxicity.fold("іdiоt")
    assert toxicity.fold("100 apples!") == " 100 appies "
    assert toxicity.fold(None) == toxicity.fold("") == "  "


@pytest.mark.parametrize("limit_mb", [64, 0.0001])
def test_lm_base_scores_and_segments(spark, limit_mb):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 60)))) for i in range(80)] + [(200, None), (201, ""), (202, "q q q"), (203, "a b c"), (203, "a b c")]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in docs], SCHEMA)
    got = lm_scoring.lm_scores(df, df.where("crc32(cast(cast(doc_id as string) as binary)) % 10 != 0"), limit_mb=limit_mb).collect()
    tokens = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for _, t in tokens for w in [*(t or "").lower().split(), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(docs)
    texts_ = dict(docs)
    for r in got:
        t = [*(texts_[r["doc_id"]] or "").lower().split(), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r["score"] < 0


def test_lm_counts_come_back_quantised(spark):
    df = spark.createDataFrame([(i, "p q " * (i + 1), "en", "s") for i in range(20)], SCHEMA)
    model = lm_scoring.train(df, owners=3)
    segment = lm_scoring.whole_model(model, lm_scoring.weigh(model, 20))
    import numpy as np
    import pyarrow as pa

    words, before, _ = lm_scoring.tokens_of(pa.array(["p q"]))
    exact = segment.word_counts(words)
    assert exact.tolist() == [210, 210, 20]
    keys = lm_scoring.pair_keys(before, words)
    pairs = segment.pair_counts(keys, segment.plan.owner(words, keys))
    assert 128 <= pairs[1] <= 256 and 16 <= pairs[0] <= 32 and np.all(pairs > 0)


def lm_corpus(n=150, vocabulary=120):
    rnd = random.Random(12)
    names = [f"w{i}" for i in range(vocabulary)]
    docs = [(i, " ".join(names[min(int(rnd.expovariate(0.08)), vocabulary - 1)] for _ in range(rnd.randint(0, 90)))) for i in range(n)]
    return docs + [(i + n, docs[i][1]) for i in range(0, n, 9)]


def lm_brute(docs, weights):
    """{id: score} with exact counts, rounded down to powers of two."""
    texts_ = [[None, *(t or "").lower().split(), ""] for _, t in docs]
    words = Counter(w for t in texts_ for w in t[1:])
    pairs = Counter(p for t in texts_ for p in zip(t, t[1:]))
    before = words | Counter({None: len(docs)})
    p = lambda w: (words[w] + 0.1) / (words.total() + 0.1 * (len(words) + 1))
    low = lambda c: 2.0 ** (c.bit_length() - 1) if c else 0.0
    one = lambda v, w: math.log10((low(pairs[v, w]) + weights.alpha * p(w)) / ((1 + weights.slack) * before[v] + weights.alpha + weights.reserve))
    return lambda text: sum(one(v, w) for t in [[None, *text.lower().split(), ""]] for v, w in zip(t, t[1:]))


@pytest.mark.parametrize("limit_mb", [64, 0])
def test_lm_scores_equal_brute_force(spark, monkeypatch, limit_mb):
    monkeypatch.setattr(lm_scoring, "LEAST_PROBES", 30)  # no false positives here
    monkeypatch.setattr(lm_scoring, "BLOCK_TEXTS", 7)
    seen, weigh = [], lm_scoring.weigh
    monkeypatch.setattr(lm_scoring, "weigh", lambda *a: seen.append(weigh(*a)) or seen[-1])
    docs = lm_corpus()
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in docs], SCHEMA).repartition(3)
    training = df.where("doc_id % 10 > 0")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(df, training, limit_mb=limit_mb).collect()}
    score = lm_brute([d for d in docs if d[0] % 10], seen[0])
    assert len(got) == len(docs)
    for i, t in docs:
        assert got[i] == pytest.approx(score(t))


def test_lm_probabilities_sum_to_one_at_most(spark):
    import numpy as np
    import pyarrow as pa

    df = spark.createDataFrame([(i, t, "en", "s") for i, t in lm_corpus(200, 900)], SCHEMA)
    model = lm_scoring.train(df)
    weights = lm_scoring.weigh(model, df.count())
    segment = lm_scoring.whole_model(model, weights)
    words = np.concatenate([np.unique(lm_scoring.tokens_of(pa.array([t for _, t in lm_corpus(200, 900)]))[0]), lm_scoring.tokens_of(pa.array(["never"]))[0][:1]])
    assert len(words) == weights.distinct + 1
    for v in [lm_scoring.START, *words[words != lm_scoring.END]]:
        value = segment.score(words, np.full(len(words), v, np.uint64))[2]
        context = segment.word_counts(np.array([v]))[0] if v != lm_scoring.START else weights.starts
        own = np.where(words == lm_scoring.END, 0.0, np.log10(weights.mass(segment.word_counts(words))))
        total = (10.0 ** (value + own)).sum() / weights.mass(context)
        assert 0.4 < total <= 1


@pytest.mark.parametrize("limit_mb", [64, 0])
def test_lm_repeated_passage_scores_below_zero_and_shared_buckets(spark, monkeypatch, limit_mb):
    monkeypatch.setattr(lm_scoring, "TASK_TOKENS", 2000)
    plan = lm_scoring.owner_plan

    def shared(texts, owners=None):
        out = plan(texts, owners)
        loads = out.parts * 0 + 1
        loads[::3] = 3
        return lm_scoring.Plan(out.bits, (loads.cumsum() - loads).astype("int32"), loads)

    monkeypatch.setattr(lm_scoring, "owner_plan", shared)
    data = [(1, "alpha beta " * 30_000, "", ""), (2, "Alpha beta", "", ""), (2, "alpha beta", "", ""), (None, "beta gamma", "", ""), (5, "x " * 50_000, "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    out = lm_scoring.lm_scores(df, df, limit_mb=limit_mb).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 5 and all(r["score"] < 0 for r in out)
    assert (got[1]["n_tokens"], got[1]["train_tokens"], got[5]["n_known"], got[None]["n_known"]) == (60_001, 110_011, 50_001, 3)
    assert got[1]["score"] > got[1]["base_score"]


def test_lm_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s")], SCHEMA)
    (r,) = lm_scoring.lm_scores(df, df.where("false")).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and math.isfinite(r["base_score"]) and math.isfinite(r["score"])
    assert lm_scoring.lm_scores(df.where("false"), df).count() == 0
