"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton after folding.

Folding lower-cases, strips accents, maps look-alike letters and digits or signs inside words to one skeleton. The
lexicon is learned from a bounded, hash-ordered sample of labelled rows: words and word beginnings that toxic texts
have and other texts hardly have, weighted by log-odds: those of many toxic texts, and more until few texts are left
without one. Phrases around lexicon words that only clean texts have become
exceptions, which silence the matches inside them. The weight found is normalised by the number of words.

Defined cases: null and empty texts score as clean; without labels of both kinds every text scores 0; a label for an
unknown id is ignored; repeated rows score alike, of entries that add as many texts the longest is taken first, and rows that repeat an id teach one text (the greatest); repeated labels
of an id count once (the larger); rows with a null id are scored, and teach nothing; an empty table gives no row; very
long texts are scored whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc_fold, documents, drop_spool, lean, share, slices, spool

#: Labelled rows that the lexicon is learned from at most.
SAMPLE = 24_000
#: Toxic texts that must have an entry (at least, and as a share); least log-odds weight; lengths of word beginnings.
SUPPORT, SHARE, WEIGHT, BEGINNINGS = 4, 0.005, 4.0, range(4, 13)
#: Share of toxic texts, and weight, from which a candidate enters the lexicon by itself.
OFTEN, CERTAIN = 0.02, 5.0
#: Clean texts that must have a phrase before it is an exception.
EXCEPTION = 2
#: Occurrences in a thousand words (and in all) from which on a text has a word's beginning densely: such entries count only there, for
#: beginnings that clean texts have now and then.
DENSE, DENSE_LEAST = 13.0, 3
#: Where between the values of clean and of toxic texts the threshold lies: long texts have small values.
MARGIN = 0.25

# Letters of other scripts that look like Latin ones, and digits or signs written for letters.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһӏкмтвнαβεικνορτυχ", "aeopcyxijsdhlkmtbhabeiknoptux")) | {"ß": "ss", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "æ": "ae", "œ": "oe"}
_WRITTEN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
_TABLE = str.maketrans(_LOOKALIKES)
_SIGNS = str.maketrans(_WRITTEN)
_IN_WORD = re.compile(r"(?<=[^\W\d_])[0-9@$]+(?![0-9@$]*[^\W\d_])\b|[0-9@$!|]+(?=[^\W\d_])")
_MARKS = re.compile("[̀-ͯ​-‍­]")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The skeleton of a text: words of folded letters, one space around each."""
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_TABLE)
    if not text.isalpha():
        text = _IN_WORD.sub(lambda m: m.group().translate(_SIGNS), text)
    return " " + _GAPS.sub(" ", text).strip().replace("l", "i") + " "  # l, I and 1 are written for each other


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word" matches a beginning, " word " a word, "# word" a beginning where it is dense
    exceptions: list[str] = field(default_factory=list)
    threshold: float = float("inf")
    slope: float = 4.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry in dict.fromkeys([*(e.removeprefix("#") for e in self.weights), *self.exceptions]):
            found.add_word(entry, (len(entry), self.weights.get(entry, 0.0), self.weights.get("#" + entry, 0.0)))
        if len(found):
            found.make_automaton()
        return found

    def feature(self, folded: str, automaton) -> float:
        """log of 1 + weight in a thousand words; matches inside an exception phrase don't count."""
        if not len(automaton):
            return 0.0
        hits, spared, dense = {}, [], {}
        for end, (size, weight, where_dense) in automaton.iter(folded):
            start = end + 1 - size
            if weight:
                hits[start] = max(hits.get(start, (0.0, 0)), (weight, end))  # one match for each word
            if where_dense:
                dense.setdefault((size, where_dense), []).append(start)
            if not weight and not where_dense:
                spared.append((start, end))
        for (size, weight), starts in dense.items():
            if is_dense(len(starts), folded):
                hits.update((a, max(hits.get(a, (0.0, 0)), (weight, a + size - 1))) for a in starts)
        total = sum(w for a, (w, b) in hits.items() if not any(x <= a and b <= y for x, y in spared))
        return float(np.log1p(1000.0 * total / (folded.count(" ") + 20)))

    def score(self, feature: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * (feature - self.threshold), -50, 50)))) if np.isfinite(self.threshold) else 0.0


def is_dense(times: int, folded: str) -> bool:
    return times >= DENSE_LEAST and 1000.0 * times >= DENSE * (folded.count(" ") + 20)


def _entries(folded: str) -> set[str]:
    words = Counter(folded.split())
    begins = Counter()
    for w, times in words.items():
        for n in BEGINNINGS:
            if n <= len(w):
                begins[w[:n]] += times
    return {f" {w} " for w in words if 2 < len(w) < 40} | {f" {b}" for b in begins} | {f"# {b}" for b, times in begins.items() if is_dense(times, folded)}


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, clean = Counter(), Counter()

    def sent() -> Iterator[pd.DataFrame]:
        rows = [(e, toxic[e], clean[e]) for e in toxic.keys() | clean.keys()]
        for i in range(0, len(rows), 100_000):
            yield pd.DataFrame(rows[i : i + 100_000], columns=["entry", "pos", "neg"])
        toxic.clear()
        clean.clear()

    for frame in frames:
        for text, label in zip(frame.text, frame.toxic):
            (toxic if label else clean).update(_entries(fold(text)))
            if len(toxic) + len(clean) > 1_000_000:  # partial counts may go out at any time
                yield from sent()
    yield from sent()


def choose(weights: dict[str, float], texts: list[list[str]], least: float) -> dict[str, float]:
    """The lexicon. ``texts``: the candidates in each toxic text.

    Candidates that many toxic texts have enter by themselves. Then the candidate that the most texts without an entry so
    far have enters (the longest on ties), again and again, while it adds ``least`` texts. Of entries that begin alike and
    stand for nearly the same texts, the longest stays; what a shorter entry matches anyway is left out."""
    holders: dict[str, set[int]] = {}
    for i, entries in enumerate(texts):
        for entry in entries:
            holders.setdefault(entry, set()).add(i)
    often = max(2 * least, OFTEN * len(texts))
    strong = sorted((e for e, h in holders.items() if len(h) >= often and weights[e] >= CERTAIN), key=lambda e: (len(e), e))
    own = [e for e in strong if not any(x != e and x.startswith(e) and len(holders[x]) >= 0.9 * len(holders[e]) for x in strong)]
    out = {e: float(weights[e]) for e in own if not any(x != e and e.startswith(x) for x in own)}
    covered = set().union(*(holders[e] for e in out)) if out else set()
    holders = {e: left for e, h in holders.items() if len(left := h - covered) >= least}
    while holders:
        best = max(holders, key=lambda e: (len(holders[e]), len(e), e))
        out[best] = float(weights[best])
        gone = holders[best].copy()
        holders = {e: left for e, h in holders.items() if len(left := h - gone) >= least}
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Learn from at most ``sample`` labelled rows, the first in the order of a hash of the id."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    ids = docs.select(F.col(id_col).alias("id")).join(known, "id").distinct()
    chosen = ids.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = spool(texts.groupBy("id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxic-sample")  # at most ``sample`` rows
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lexicon = Lexicon()
    if len(sizes) < 2:
        return lexicon
    counts = rows.mapInPandas(lean(_counted), "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    least = max(SUPPORT, SHARE * sizes[1])
    weight = F.log((F.col("pos") + 0.5) / (sizes[1] + 1)) - F.log((F.col("neg") + 0.5) / (sizes[0] + 1))
    likely = counts.select("entry", "pos", weight.alias("w")).where((F.col("pos") >= least) & (F.col("w") >= WEIGHT)).toPandas()
    weights = dict(zip(likely.entry, likely.w))
    candidates = share(spark, weights)

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"entries": [sorted(_entries(fold(t)) & candidates.value.keys()) for t in frame.text]})

    # copies of one text count once here, or its chance words would look like evidence
    toxic = rows.where("toxic = 1").select("text").distinct().mapInPandas(lean(held), "entries array<string>").toPandas()
    lexicon.weights = choose(weights, list(toxic.entries), least)
    if not lexicon.weights:
        return lexicon
    shared = share(spark, lexicon)

    def phrases(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = shared.value.automaton()
        for frame in frames:
            out = []
            for text, label in zip(frame.text, frame.toxic):
                folded, found = fold(text), set()
                for end, (size, weight, _) in automaton.iter(folded):
                    if not weight:
                        continue
                    start = end + 1 - size
                    stop = folded.index(" ", start + 1)
                    before, after = folded.rfind(" ", 0, start) if start else -1, folded.find(" ", stop + 1)
                    found |= {folded[before : stop + 1]} if before >= 0 else set()
                    found |= {folded[start : after + 1]} if after >= 0 else set()
                out += [(p, int(label)) for p in found]
            yield pd.DataFrame(out, columns=["phrase", "toxic"])

    spared = rows.mapInPandas(lean(phrases), "phrase string, toxic int").groupBy("phrase").agg(F.max("toxic").alias("toxic"), F.count("*").alias("n"))
    lexicon.exceptions = sorted(r["phrase"] for r in spared.where((F.col("toxic") == 0) & (F.col("n") >= EXCEPTION)).collect())
    tuned = share(spark, lexicon)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = tuned.value.automaton()
        for frame in frames:
            yield pd.DataFrame({"f": [tuned.value.feature(fold(t), automaton) for t in frame.text], "toxic": frame.toxic})

    seen = rows.mapInPandas(lean(features), "f double, toxic int").toPandas().sort_values("f")
    drop_spool(rows)
    values, edges = np.unique(seen.f, return_index=True)
    labels_ = seen.toxic.to_numpy()
    right = np.array([(labels_[:e] == 0).sum() + (labels_[e:] == 1).sum() for e in edges])  # right if all below the value are clean
    best = int(right[1:].argmax()) + 1 if len(values) > 1 else 0
    if best:
        lexicon.threshold = float(values[best - 1] + MARGIN * (values[best] - values[best - 1]))
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score (0 to 1), predicted (1 if the score is 0.5 or more)."""
    shared = share(docs.sparkSession, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        automaton = lexicon.automaton()
        for part in (part for batch in batches for part in slices(batch, "text", 1 << 20)):
            score = [lexicon.score(lexicon.feature(fold(t), automaton)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(lean(run), "doc_id long, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    lexicon = train(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")
