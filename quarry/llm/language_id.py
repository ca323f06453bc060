"""Language identification by nearest centroid, with distance-based rejection.

Texts become normalised TF-IDF vectors of hashed byte 1- to 3-grams (letters lower-cased, all else one space). Training
takes a bounded, hash-ordered sample of labelled rows, clusters each language into a few spherical centroids, and
notes, per length of text, how near training texts, and pieces cut out of them, are to their centroids; farther texts are rejected.
Each language is clustered in a task of its own; the driver gets centroids (32 KB a language) and document frequencies only.

Defined cases: a text that is null or has no letter is ``und``, score 0, rejected; without any labelled row every text
is ``und``; any number of languages is learned; of centroids that are equally near the first counts, in the order of
languages; an empty table gives no row; repeated rows are predicted alike, and rows that repeat an id teach one text a language; rows with a null id
are predicted like others; very long texts are read whole, some at a time; other columns are ignored (or passed on by
``filter_language``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import crc_fold, documents, drop_spool, lean, share, slices, spool, text_bytes

#: Hashed dimensions; labelled rows a language may give at most; centroids a language.
DIMS, SAMPLE, CENTROIDS = 2048, 600, 4
#: Texts whose vectors are held at a time.
ROWS = 1000
#: Characters of the pieces cut out of the training texts, to tell how near short texts are.
PIECES = (4, 8, 16, 32, 64, 128)
#: Share of training texts of a length that may lie outside, and how much farther still counts as near.
TAIL, SLACK = 0.01, 0.6

_LETTER = np.zeros(256, dtype=np.uint32)
for _b in range(256):
    _LETTER[_b] = _b if chr(_b).islower() and _b < 128 or _b >= 128 else _b + 32 if 65 <= _b <= 90 else 32
_LETTER[0:65][_LETTER[0:65] < 97] = 32


def gram_counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams, a row of DIMS for each text."""
    raw, ends = text_bytes(column)
    out = np.zeros((len(ends) - 1, DIMS), dtype=np.float32)
    step = 1 << 20
    for i in range(len(ends) - 1):
        for a in range(ends[i], ends[i + 1], step):
            b = _LETTER[raw[a : min(a + step + 2, ends[i + 1])]]
            keep = b != 32
            keep[1:] |= keep[:-1]  # one space after a run of letters
            b = b[keep]
            n = len(b)
            with np.errstate(over="ignore"):
                one = b * np.uint32(0x9E3779B1)
                two = (b[:-1] * np.uint32(257) + b[1:]) * np.uint32(0x85EBCA6B)
                three = (b[:-2] * np.uint32(66049) + b[1:-1] * np.uint32(257) + b[2:]) * np.uint32(0xC2B2AE35)
            for h in (one, two, three) if n > 2 else (one, two) if n > 1 else (one,):
                out[i] += np.bincount(h >> np.uint32(21), minlength=DIMS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    near: np.ndarray  # least similarity that is accepted, by length_class

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, similarity and whether it was rejected, for each text."""
        counts = gram_counts(column)
        letters = np.array([has_letter(t) for t in column.to_pylist()], dtype=bool)
        if not self.langs:
            return ["und"] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        like = vectors(counts, self.idf) @ self.centroids.T
        best = like.argmax(axis=1) if len(column) else np.zeros(0, int)
        score = np.where(letters, np.clip(like[np.arange(len(column)), best], 0.0, 1.0), 0.0).astype(float)
        rejected = ~letters | (score < self.near[length_class(counts)])
        return [self.langs[self.owner[c]] if ok else "und" for c, ok in zip(best, letters)], score, rejected


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(counts.sum(axis=1) + 1).astype(int), 0, 31)


def _cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, begun from texts that are far from each other."""
    centres = v[:1]
    for _ in range(min(k, len(v)) - 1):
        centres = np.vstack([centres, v[(v @ centres.T).max(axis=1).argmin()]])
    for _ in range(12):
        nearest = (v @ centres.T).argmax(axis=1)
        sums = np.vstack([v[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(lang, text) of at most ``sample`` rows a language: those with the least hash of the id.

    Languages are counted first, so that only a few more rows than wanted meet where a language's first ones are found."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h")
    )
    ids = rows.select("id", "lang", "h").distinct()
    sizes = ids.groupBy("lang").agg(F.count("*").alias("size"))
    part = (1.5 * sample + 200) / F.col("size")  # far more than ``sample`` with any odds
    few = sizes.agg(F.coalesce(F.sum(F.least("size", F.lit(sample))), F.lit(0))).first()[0] <= 1_000_000  # so many rows are chosen, and no more languages
    sizes = F.broadcast(sizes) if few else sizes
    likely = ids.join(sizes, "lang").where((part >= 1) | (F.col("h").cast("double") < part * 2.0**64 - 2.0**63))
    first = Window.partitionBy("lang").orderBy("h", "id")
    chosen = likely.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= sample).select("id", "lang")
    return rows.join(F.broadcast(chosen) if few else chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


@lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", rows=ROWS // 4):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.astype(np.uint32).tobytes() for c in gram_counts(part.column(1))], pa.binary())], ["lang", "counts"])


def _counts(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.vstack([np.frombuffer(b.as_py(), np.uint32) for b in column])


@lean
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of texts, and in how many of them each gram occurs: one row."""
    n, seen = 0, np.zeros(DIMS, np.int64)
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.column(1).slice(i, 500)
            n, seen = n + len(part), seen + (_counts(part) > 0).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([seen.tobytes()], pa.binary())], ["n", "seen"])


def _centroids(idf: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        counts = _counts(table.column("counts")).astype(np.float32)
        counts = counts[np.lexsort(counts[:, :8].T)]  # rows come in any order
        found = _cluster(vectors(counts, idf), CENTROIDS).astype(np.float32)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(found), pa.string()), "at": pa.array(range(len(found)), pa.int32()), "centroid": pa.array([c.tobytes() for c in found], pa.binary())})

    return run


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows a language (the first in the order of a hash of the id); every language counts."""
    picked = spool(_sample(labelled, id_col, text_col, lang_col, sample), "language-sample")
    grams = spool(picked.mapInArrow(_features, "lang string, counts binary"), "language-grams")
    seen = grams.mapInArrow(_frequencies, "n long, seen binary").toArrow()
    if not seen.num_rows:
        return Model([], np.zeros(0, int), np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros(32))
    idf = np.log((1 + sum(seen.column("n").to_pylist())) / (1 + sum(np.frombuffer(b, np.int64) for b in seen.column("seen").to_pylist()))).astype(np.float32) + np.float32(1)
    found = grams.groupBy("lang").applyInArrow(_centroids(idf), "lang string, at int, centroid binary").toArrow().sort_by([("lang", "ascending"), ("at", "ascending")])
    drop_spool(grams)
    names = sorted(set(found.column("lang").to_pylist()))
    centroids = np.vstack([np.frombuffer(b, np.float32) for b in found.column("centroid").to_pylist()])
    owner = np.searchsorted(names, found.column("lang").to_pylist())
    model = Model(names, owner, centroids, idf, np.zeros(32))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text, and of pieces from its middle: class of length, and similarity to its language."""
        for batch in batches:
            for part in slices(batch, "text", rows=ROWS // 4):
                texts = part.column(1).to_pylist()
                cuts = [t[len(t) // 2 :][:n] for n in PIECES for t in texts]
                own = np.tile(np.searchsorted(model.langs, part.column(0).to_pylist()), 1 + len(PIECES))
                c = np.vstack([gram_counts(part.column(1)), gram_counts(pa.array(cuts, pa.string()))])
                like = np.where(model.owner[None, :] == own[:, None], vectors(c, model.idf) @ model.centroids.T, -1).max(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(length_class(c).astype(np.int32)), pa.array(like.astype(float))], ["size", "like"])

    seen = picked.mapInArrow(lean(similar), "size int, like double").toArrow()
    drop_spool(picked)
    size, like = (np.asarray(seen.column(c)) for c in ("size", "like"))
    fit = [c for c in range(1, 32) if (size == c).sum() >= 20]
    for c in range(32):
        if fit and c:  # without letters there is nothing to measure
            near = max((x for x in fit if x <= c), default=fit[0])
            model.near[c] = SLACK * float(np.quantile(like[size == near], TAIL))
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score (cosine), rejected."""
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20, ROWS):
                lang, score, rejected = shared.value.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(lean(run), "doc_id long, lang_pred string, score double, rejected boolean")


def filter_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model does not reject."""
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20, ROWS):
                yield part.filter(pa.array(~shared.value.predict(part.column(text_col))[2]))

    return docs.mapInArrow(lean(run), docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
