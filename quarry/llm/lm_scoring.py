"""Language-model scoring with a log-frequency Bloom filter.

Training counts words and word pairs of all training texts. Words fall into buckets by their hash, buckets into owners by
their counted tokens, so owners are of one size; a bucket with too many tokens is shared by several owners, each with a
part of its pairs. Map tasks send an owner their distinct words and pairs with counts; it adds them up and builds its slice
of the model: exact word counts, and a Bloom filter that holds each pair once for each level its count reaches (level q:
at least 2**(q-1)). A probe goes up the levels until one is absent; the pair's count is taken as the least of its level.

Scoring: log10 of (count(v,w) + alpha * p(w)) / ((1 + slack) * count(v) + alpha + reserve), where p is the add-0.1 word
probability of the base score and v the word before w (a text's first word follows a start token). The probabilities
after a word sum to 1 at most: quantised counts are never above the true ones, and ``slack`` and ``reserve`` hold more than
the mass that false positives of the filter are expected to add, which the filters' measured filling and the number
of distinct words give. Probes a level grow with the vocabulary, so the reserve stays small. ``alpha`` has the greatest
leave-one-out likelihood over all training pairs, by histograms of their counts.

A model of at most LIMIT_MB is broadcast. Of a greater one no worker needs all: the probes go to the owners, in one
shuffle, and each owner's slice is given to the few tasks that probe it.

Defined cases: null text counts as empty and scores its end token only; without training rows all counts are 0; an empty
table gives no row; repeated rows count and score one by one; very long texts are read whole, some words at a time; rows with a null id are scored like others; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc_fold, documents, lean, mix, share, slices, spool, tidied, word_hashes

#: Most of a model that is broadcast, in MB; bytes of text an owner has, about; tokens a map task counts before it sends.
LIMIT_MB, OWNER_BYTES, FLUSH = 24, 12 << 20, 3_000_000
#: Expected false positives after a word that the probes allow; least probes a level; filled share of a filter.
FALSE, LEAST_PROBES, FILL = 64, 8, 0.5
#: Tokens and texts of a block of probes; probed tokens that ask one copy of a slice, about; tasks at most.
BLOCK_TOKENS, BLOCK_TEXTS, TASK_TOKENS, TASKS = 1_500_000, 50_000, 6_000_000, 20_000

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64((1 << 40) - 1)
_HIST = 64
#: Probes after which absent pairs are left out.
_DROP = {0, 1, 3, 6}


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of the word before, 40 bits count; they are all that is sent."""
    with np.errstate(over="ignore"):
        return mix((before & _LOW) * _PAIR + words)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, the hash before each, and n+1 offsets."""
    words, ends = word_hashes(column)
    out = np.insert(words, ends[1:], END)
    offsets = ends + np.arange(len(ends))
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[offsets[:-1]] = START
    return out, before, offsets


def _narrow(before: np.ndarray) -> bytes:
    return np.ascontiguousarray(before.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _wide(data: bytes) -> np.ndarray:
    five = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view("<u8").ravel()


# ---------------------------------------------------------------- owners


@dataclass
class Plan:
    bits: int  # buckets are the first bits of a word's hash
    first: np.ndarray  # first owner of each bucket
    parts: np.ndarray  # owners that share the bucket's pairs

    @property
    def owners(self) -> int:
        return int(self.first[-1] + self.parts[-1])

    def bucket(self, words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(64 - self.bits)).astype(np.int64)

    def owner(self, words: np.ndarray, keys: np.ndarray) -> np.ndarray:
        b = self.bucket(words)
        own = self.first[b].astype(np.int64)
        shared = self.parts[b] > 1
        if shared.any():
            own[shared] += (keys[shared] % self.parts[b[shared]].astype(np.uint64)).astype(np.int64)
        return own

    def span(self, owner: int) -> int:
        """Buckets of an owner."""
        return max(1, int(np.searchsorted(self.first, owner, side="right") - np.searchsorted(self.first, owner)))


def owner_plan(texts: DataFrame, owners: int | None = None) -> Plan:
    """Owners by counted tokens; with ``owners`` given, that many ranges of hashes."""
    if owners:
        return Plan(6, (np.arange(64) * owners >> 6).astype(np.int32), np.ones(64, np.int32))
    size = int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    bits = min(20, max(6, (size // OWNER_BYTES).bit_length() + 2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                loads += np.bincount((tokens_of(part.column(0))[0] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(loads)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(loads[at])], ["bucket", "n"])

    rows = texts.mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # 2**20 numbers at most
    loads = np.zeros(1 << bits, np.int64)
    for r in rows:
        loads[r["bucket"]] = r["n"]
    target = max(1, int(loads.sum()) * OWNER_BYTES // max(size, 1), 100_000)
    first, parts, at, held = np.zeros(1 << bits, np.int32), np.ones(1 << bits, np.int32), 0, 0
    for b, n in enumerate(loads.tolist()):
        if held and held + n > target:
            at, held = at + 1, 0
        first[b] = at
        if n > 2 * target:
            parts[b] = -(-n // target)
            at, held = at + int(parts[b]), 0
        else:
            held += n
    return Plan(bits, first, parts)


# ---------------------------------------------------------------- counting


def _counted(plan: Plan, words: np.ndarray, before: np.ndarray) -> Iterator[tuple]:
    """For each owner: distinct words and counts, and the pairs that are its own, by word, with the counts above 1."""
    distinct, inverse, counts = np.unique(words, return_inverse=True, return_counts=True)
    pairs = np.sort(inverse.astype(np.uint64) << np.uint64(40) | before & _LOW)
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    pairs, times = pairs[first], np.diff(np.append(first, len(pairs)))
    index, ahead = (pairs >> np.uint64(40)).astype(np.int64), pairs & _LOW
    buckets = plan.bucket(distinct)
    owner = plan.owner(distinct[index], pair_keys(ahead, distinct[index]))
    lows, highs = plan.first[buckets], plan.first[buckets] + plan.parts[buckets]
    for own in np.unique(np.concatenate([np.arange(a, b) for a, b in set(zip(lows.tolist(), highs.tolist()))])).tolist():
        a, b = np.searchsorted(highs, own, side="right"), np.searchsorted(lows, own, side="right")
        x, y = np.searchsorted(index, a), np.searchsorted(index, b)
        mine = slice(x, y) if plan.parts[buckets[a]] == 1 else x + np.flatnonzero(owner[x:y] == own)
        times_, many = times[mine], np.flatnonzero(times[mine] > 1)
        per_word = np.bincount(index[mine] - a, minlength=b - a)
        yield own, distinct[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes(), per_word.astype(np.uint32).tobytes(), _narrow(ahead[mine]), many.astype(np.uint32).tobytes(), times_[many].astype(np.uint32).tobytes()


_SENT = ["owner", "words", "counts", "per_word", "before", "many", "times"]


def _count(plan):
    def send(held: list) -> pa.RecordBatch:
        cols = list(zip(*_counted(plan.value, *map(np.concatenate, zip(*held)))))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words, before, _ = tokens_of(part.column(0))
                for i in range(0, len(words), FLUSH):
                    held.append((words[i : i + FLUSH], before[i : i + FLUSH]))
                    n += len(held[-1][0])
                    if n >= FLUSH:
                        yield send(held)
                        held, n = [], 0
        if n:
            yield send(held)

    return lean(run)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for 0, else the number of binary digits."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the least one."""
    return np.where(level > 0, 2.0 ** (level - 1), 0.0)


def _places(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(level) * np.uint64(0xD1B54A32D192ED03))
        return h, (h * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _bit(h: np.ndarray, step: np.ndarray, i: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """The i-th probed bit, below ``bits`` (less than 2**32)."""
    with np.errstate(over="ignore"):
        return (h + np.uint64(i) * step >> np.uint64(32)) * bits >> np.uint64(32)


def _slice(plan):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """An owner's part of the model."""
        read = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in rows[name]])
        own = int(rows.owner.iloc[0])
        words, counts = _added(read("words", np.uint64), read("counts", np.uint32))
        keys, times = [], []
        for row in rows.itertuples(index=False):
            keys.append(pair_keys(_wide(row.before), np.repeat(np.frombuffer(row.words, np.uint64), np.frombuffer(row.per_word, np.uint32))))
            times.append(np.ones(len(keys[-1]), np.uint32))
            times[-1][np.frombuffer(row.many, np.uint32)] = np.frombuffer(row.times, np.uint32)
        of_pairs = np.concatenate([np.repeat(np.frombuffer(r.words, np.uint64), np.frombuffer(r.per_word, np.uint32)) for r in rows.itertuples(index=False)])
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.zeros(0, int)
        pairs, of_pairs = keys[order][first], of_pairs[order][first]
        pair_counts = np.add.reduceat(times[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        del keys, order

        whole = plan.value.parts[plan.value.bucket(words[:1])[0]] == 1
        primary = whole or own == plan.value.first[plan.value.bucket(words[:1])[0]]
        vocabulary = len(words) * (1 << plan.value.bits) / plan.value.span(own)
        probes = int(min(40, max(LEAST_PROBES, np.ceil(np.log2(max(vocabulary, 1) / FALSE)))))
        level = levels(pair_counts)
        bits = int(min((1 << 32) - 8, max(64, -(-int(level.sum()) * probes / np.log(1 / (1 - FILL)) // 8) * 8)))
        table = np.zeros(bits, dtype=bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            h, step = _places(pairs[level >= q], q)
            for i in range(probes):
                table[_bit(h, step, i, np.uint64(bits)).astype(np.int64)] = True
        # leave-one-out histograms: tokens by (level of the pair's other occurrences, level of the word's count), and by level of the context's count
        of_word = levels(counts[np.searchsorted(words, of_pairs)]) if len(pairs) else np.zeros(0, np.int64)
        hist = np.bincount(levels(pair_counts - 1) * _HIST + of_word, weights=pair_counts, minlength=_HIST * _HIST)
        at = np.flatnonzero(hist)
        context = counts * (words != END)
        hist_ = np.bincount(levels(counts - 1), weights=context, minlength=_HIST) if primary else np.zeros(_HIST)
        at_ = np.flatnonzero(hist_)
        return pd.DataFrame(
            {"owner": [own], "first": [bool(primary)], "words": [words.tobytes()], "counts": [counts.tobytes()], "bits": [bits], "probes": [probes],
             "filter": [np.packbits(table, bitorder="little").tobytes()], "filled": [float(table.mean())], "total": [int(counts.sum()) if primary else 0], "distinct": [len(words) if primary else 0],
             "own_words": [len(words) / (1 if whole else int(plan.value.parts[plan.value.bucket(words[:1])[0]]))], "tokens": [int(pair_counts.sum())], "size": [len(words) * 16 + bits // 8],
             "cells": [np.concatenate([at, at_ + _HIST * _HIST]).tolist()], "weights": [np.concatenate([hist[at], hist_[at_]]).tolist()]}
        )

    return run


_MODEL = "owner int, first boolean, words binary, counts binary, bits long, probes int, filter binary, filled double, total long, distinct long, own_words double, tokens long, size long, cells array<int>, weights array<double>"


def train(docs: DataFrame, text_col: str = "text", owners: int | None = None) -> DataFrame:
    """The model's slices, one row an owner, as a table in the shared folder."""
    texts = docs.select(F.col(text_col).alias("text"))
    plan = owner_plan(texts, owners)
    shared = share(docs.sparkSession, plan)
    sent = texts.mapInArrow(_count(shared), "owner int, " + ", ".join(f"{c} binary" for c in _SENT[1:]))
    out = spool(sent.groupBy("owner").applyInPandas(_slice(shared), _MODEL), "lm-model")
    out.plan = plan
    return out


@dataclass
class Weights:
    """Numbers that hold for the whole model."""

    total: int
    distinct: int
    starts: int  # training texts
    alpha: float
    reserve: float
    slack: float

    def share(self, count: np.ndarray) -> np.ndarray:
        """The word probability of the base score."""
        return (count + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def mass(self, count: np.ndarray | float) -> np.ndarray | float:
        return (1 + self.slack) * count + self.alpha + self.reserve


def weigh(model: DataFrame, starts: int) -> Weights:
    """Totals, the mass that false positives may have, and the weight of the word distribution."""
    false = F.pow(F.col("filled"), F.col("probes"))
    r = model.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v"), F.sum(F.col("own_words") * false).alias("expected"), F.max(false).alias("most")).first()
    if not r["n"]:
        return Weights(0, 0, starts, 1.0, 1.0, 0.0)
    expected = r["expected"]
    out = Weights(r["n"], r["v"], starts, 1.0, 2 * expected + 6 * expected**0.5 + 8, min(1.0, 4 * r["most"]))
    cells = model.select(F.explode(F.arrays_zip("cells", "weights")).alias("x")).groupBy("x.cells").agg(F.sum("x.weights").alias("n")).collect()  # 4,160 numbers at most
    hist = np.zeros(_HIST * _HIST + _HIST)
    for c, n in cells:
        hist[c] = n
    pairs, context = hist[: _HIST * _HIST].reshape(_HIST, _HIST), hist[_HIST * _HIST :]
    others = level_count(np.arange(_HIST))
    p = out.share(1.4 * others)  # about the middle of a level
    best = -np.inf
    for alpha in 2.0 ** np.arange(0, 24, 0.5):
        out_ = Weights(out.total, out.distinct, starts, float(alpha), out.reserve, out.slack)
        found = (pairs * np.log(others[:, None] + alpha * p[None, :])).sum() - (context * np.log(out_.mass(others))).sum() - starts * np.log(out_.mass(max(0, starts - 1)))
        if found > best:
            best, kept = found, out_
    return kept


# ---------------------------------------------------------------- scoring


@dataclass
class Segment:
    """Slices of the model at hand, and how to probe them."""

    plan: Plan
    weights: Weights
    words: np.ndarray
    counts: np.ndarray
    bits: np.ndarray  # of each owner's filter; 0: not here
    probes: np.ndarray
    begins: np.ndarray  # of each owner's filter, in bytes
    filter: np.ndarray
    lowest: int = 0  # owner that the three arrays begin with

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0).astype(np.int64)

    def pair_counts(self, keys: np.ndarray, owner: np.ndarray | int) -> np.ndarray:
        level, q = np.zeros(len(keys), np.int64), 1
        if isinstance(owner, int):  # one owner's pairs
            live = np.arange(len(keys)) if self.bits[owner - self.lowest] else np.zeros(0, np.int64)
        else:
            owner = owner - self.lowest
            live = np.flatnonzero(self.bits[owner] > 0)
        while len(live):
            h, step = _places(keys[live], q)
            own = owner - self.lowest if isinstance(owner, int) else owner[live]
            size, begin, probes = self.bits[own].astype(np.uint64), self.begins[own], self.probes[own]
            there = np.ones(len(live), bool)
            for i in range(int(np.max(probes))):
                at = _bit(h, step, i, size)
                there &= ((self.filter[(at >> np.uint64(3)).astype(np.int64) + begin] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) | (i >= probes)
                if i in _DROP and not there.all():  # those that are absent leave now and then
                    live, h, step = live[there], h[there], step[there]
                    if not isinstance(owner, int):
                        size, begin, probes = size[there], begin[there], probes[there]
                    there = np.ones(len(live), bool)
                    if not len(live):
                        break
            live = live[there]
            level[live] = q
            q += 1
        return level_count(level)

    def score(self, words: np.ndarray, before: np.ndarray, owner: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its count, and its part of base score and score. A word is also the context of what follows it.

        With ``owner`` given, words are in order and all that owner's."""
        keys = pair_keys(before, words)
        if owner is None:
            distinct, inverse = np.unique(words, return_inverse=True)
            owner = self.plan.owner(words, keys)
        else:
            new = np.ones(len(words), bool)
            new[1:] = words[1:] != words[:-1]
            distinct, inverse = words[new], np.cumsum(new) - 1
        counts = self.word_counts(distinct)
        share = self.weights.share(counts)
        context = np.where(distinct == END, 0.0, np.log10(self.weights.mass(counts)))
        value = np.log10(self.pair_counts(keys, owner) + (self.weights.alpha * share)[inverse]) - context[inverse]
        return counts[inverse], np.log10(share)[inverse], value

    def score_texts(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score and score."""
        words, before, offsets = tokens_of(column)
        counts, base, value = self.score(words, before)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        add = lambda x: np.bincount(text, weights=x, minlength=len(offsets) - 1)
        return np.diff(offsets), add(counts > 0).astype(np.int64), add(base), add(value) - np.log10(self.weights.mass(self.weights.starts))


def whole_model(model: DataFrame, weights: Weights) -> Segment:
    """The slices of a model of bounded size, together."""
    rows = model.select("owner", "first", "words", "counts", "bits", "probes", "filter").orderBy("owner").collect()
    n = model.plan.owners
    bits, probes, begins, at = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64), 0
    for r in rows:
        bits[r["owner"]], probes[r["owner"]], begins[r["owner"]] = r["bits"], r["probes"], at
        at += len(r["filter"])
    table = np.concatenate([*[np.frombuffer(r["filter"], np.uint8) for r in rows], np.zeros(1, np.uint8)])
    join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows if r["first"]] or [np.zeros(0, kind)])
    return Segment(model.plan, weights, join("words", np.uint64), join("counts", np.int64), bits, probes, begins, table)


def _one_slice(plan: Plan, weights: Weights, owner: int, row: dict | None) -> Segment:
    if row is None:  # words of no training text
        none = np.zeros(1, np.int64)
        return Segment(plan, weights, np.zeros(0, np.uint64), none, none, none + 1, none, np.zeros(1, np.uint8), owner)
    table = np.frombuffer(row["filter"], np.uint8)
    return Segment(plan, weights, np.frombuffer(row["words"], np.uint64), np.frombuffer(row["counts"], np.int64), np.array([row["bits"]]), np.array([row["probes"]]), np.zeros(1, np.int64), table, owner)


_TABLE = "owner int, part int, kind int, block long, words binary, counts binary, filter binary, texts binary, bits long, probes int, ids array<long>, sizes array<int>"
_COLUMNS = [c.split()[0] for c in _TABLE.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
_PARTIAL = "block long, texts binary, known binary, base binary, value binary, ids array<long>, sizes array<int>"
_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _ask(plan, parts):
    """Blocks of texts: a row with the ids and sizes of its texts, and for each owner a row of probes."""

    def block(number: int, held: list) -> Iterator[pa.RecordBatch]:
        ids = [i for x in held for i in x[0]]
        words, before = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        sizes = np.concatenate([x[3] for x in held])
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rows = [(-1, 0, 1, number, None, None, None, None, None, None, ids, sizes.tolist())]
        owner = plan.value.owner(words, pair_keys(before, words))
        order = np.lexsort((words, owner)) if (plan.value.parts > 1).any() else np.argsort(words, kind="stable")
        words, before, text, owner = words[order], before[order], text[order], owner[order]
        edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
        for a, b in zip(edges, edges[1:]):
            own = int(owner[a])
            distinct, n = np.unique(words[a:b], return_counts=True)
            rows.append((own, number % int(parts.value[own]), 1, number, distinct.tobytes(), n.astype(np.uint32).tobytes(), _narrow(before[a:b]), text[a:b].astype(np.uint16).tobytes(), None, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, texts = TaskContext.get().partitionId() << 24, [], 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                words, before, offsets = tokens_of(part.column(1))
                for i in range(0, part.num_rows, BLOCK_TEXTS):
                    j = min(i + BLOCK_TEXTS, part.num_rows)
                    if held and (n >= BLOCK_TOKENS or texts + j - i > BLOCK_TEXTS):
                        yield from block(number, held)
                        number, held, n, texts = number + 1, [], 0, 0
                    a, b = offsets[i], offsets[j]
                    held.append((part.column(0)[i:j].to_pylist(), words[a:b], before[a:b], np.diff(offsets[i : j + 1])))
                    n, texts = n + b - a, texts + j - i
        if held:
            yield from block(number, held)

    return lean(run)


def _answer(plan, weights: Weights):
    """The tables and probes of an owner come one after the other: scores of each block's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, segment = None, None
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(_COLUMNS)}
                if row["owner"] < 0:
                    rows.append((row["block"], None, None, None, None, row["ids"], row["sizes"]))
                    continue
                if row["kind"] == 0:
                    here, segment = (row["owner"], row["part"]), _one_slice(plan.value, weights, row["owner"], row)
                    continue
                if here != (row["owner"], row["part"]):
                    here, segment = (row["owner"], row["part"]), _one_slice(plan.value, weights, row["owner"], None)
                words = np.repeat(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["counts"], np.uint32))
                counts, base, value = segment.score(words, _wide(row["filter"]), row["owner"])
                texts, at = np.unique(np.frombuffer(row["texts"], np.uint16), return_inverse=True)
                known, base, value = (np.bincount(at, weights=x, minlength=len(texts)) for x in (counts > 0, base, value))
                rows.append((row["block"], texts.tobytes(), known.astype(np.uint32).tobytes(), base.tobytes(), value.tobytes(), None, None))
            if rows:
                kinds = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _PARTIAL.split(", ")])

    return lean(run)


def _gather(weights: Weights):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """A block's texts, with the sums of what the owners gave."""
        (head,) = rows[rows.sizes.notna()].itertuples(index=False)
        sums = np.zeros((3, len(head.sizes)))
        for row in rows[rows.sizes.isna()].sort_values("texts").itertuples(index=False):
            at = np.frombuffer(row.texts, np.uint16)
            for k, part in enumerate((np.frombuffer(row.known, np.uint32), np.frombuffer(row.base), np.frombuffer(row.value))):
                sums[k, at] += part
        ids = pd.array([None if i is None or i != i else int(i) for i in head.ids], "Int64")
        return pd.DataFrame({"doc_id": ids, "n_tokens": np.asarray(head.sizes, np.int64), "n_known": sums[0].astype(np.int64), "base_score": sums[1], "score": sums[2] - np.log10(weights.mass(weights.starts))})

    return run


def _by_probes(own: DataFrame, model: DataFrame, weights: Weights) -> DataFrame:
    """Scores by probes that go to the owners' slices; a slice that many tokens ask is given to several tasks."""
    spark = own.sparkSession
    tokens = model.select("owner", "tokens").collect()  # a number an owner
    parts = np.ones(model.plan.owners, np.int32)
    for r in tokens:
        parts[r["owner"]] = max(1, -(-r["tokens"] // TASK_TOKENS))
    plan, shared = share(spark, model.plan), share(spark, parts)
    owners = model.plan.owners
    tasks = min(TASKS, owners)  # owners lie evenly over the tasks, copies of a slice in tasks that follow
    copies = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / TASK_TOKENS).cast("int") - 1))
    given = {"kind": F.lit(0), "block": F.lit(None), "texts": F.lit(None), "ids": F.lit(None), "sizes": F.lit(None)}
    tables = model.withColumn("part", F.explode(copies)).select(*[given.get(c.split()[0], F.col(c.split()[0])).cast(c.split()[1]).alias(c.split()[0]) for c in _TABLE.split(", ")])
    asked = own.mapInArrow(_ask(plan, shared), _TABLE).unionByName(tables)
    # rows about texts have owner -1: they are dealt by block
    task = F.when(F.col("owner") < 0, F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int")).otherwise(F.expr(f"cast((cast(owner as long) * {tasks} div {owners} + part) % {tasks} as int)"))
    dealt = asked.repartitionById(tasks, task).sortWithinPartitions("owner", "part", "kind")
    return dealt.mapInArrow(_answer(plan, weights), _PARTIAL).groupBy("block").applyInPandas(_gather(weights), _SCORED)


@tidied
def lm_scores(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_mb: float = LIMIT_MB) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    model = train(training, text_col)
    weights = weigh(model, training.count())
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if (model.agg(F.sum("size")).first()[0] or 0) <= limit_mb * 1e6:
        shared = share(docs.sparkSession, whole_model(model, weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, shared.value.score_texts(part.column(1)))], [c.split()[0] for c in _SCORED.split(", ")])

        out = own.mapInArrow(lean(run), _SCORED)
    else:
        out = _by_probes(own, model, weights)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(weights.total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_fold(F.col("doc_id"), 10) == 0
    scores = lm_scores(docs, docs.where(~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
