"""Benchmark decontamination by spaced seeds.

A seed is a window of 6 to 14 tokens of which a fixed mask reads 6 or 7. The masks together meet every passage that can be
accepted (12 tokens and 75 % agree), wherever it differs: all patterns of 16 tokens with 4 differing, 20 with 5, 24 with 6
and 28 with 7 hold a seed (a test enumerates them), which shorter and other lengths up to 31 follow from, and a longer
passage has a part of 16 to 31 tokens that agrees in as large a share. Seed hashes of the benchmark items are joined with those of the documents; at a
hit, document and item are laid on each other, and the best stretch (a token that agrees counts 1, one that differs -2)
or all of the overlap must agree in enough tokens. Items of fewer than 11 tokens are one seed of their own length and must be met whole.

The benchmark goes out in blocks of at most ``BLOCK_TOKENS`` tokens (one item at least), one pass over the documents for
each, so a broadcast never grows with the tables.

Seeds of a word that comes again and again, in a text and in an item, are not listed pair by pair: the diagonals between
them are looked at once each, until one agrees in the whole item.

Defined cases: null or empty texts and items match nothing; an empty table of documents gives no row, an empty benchmark
matches nothing; very long texts are looked at whole; repeated rows give one match each; repeated items (same id
and text) count once, an id with two texts counts as two items; rows with a null id are looked at like others; of stretches
that agree in as many tokens the first counts; words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; other columns are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, lean, mix, share, slices, word_hashes

# The masks.
MASKS = ["11111001001", "10010101111", "11000111101", "10101100111", "1101001000011", "11011101", "11000000011011", "10100101000011", "1110111", "1111010001"]
#: Tokens from which on an item is met by the masks.
SPAN = 11
#: Tokens that must agree, and at least this share of the stretch; tokens of a benchmark block.
AGREE, SHARE, BLOCK_TOKENS = 12, 0.75, 2_000_000
#: Hits that are listed at a time; hits of one seed from which on the range of its diagonals is looked at instead.
EXPANDED, HEAVY = 1_000_000, 1024

_ODD = [np.uint64(int(x)) for x in np.random.default_rng(5).integers(1, 1 << 63, SPAN, dtype=np.int64) | 1]


def seeds(tokens: np.ndarray, offsets: list[int], salt: int) -> np.ndarray:
    """A hash of the tokens at the offsets from each place where they all exist."""
    n = len(tokens) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, salt, dtype=np.uint64)
        for o, odd in zip(offsets, _ODD):
            h += mix(tokens[o : o + n] + odd) * odd
    return h


@dataclass
class Block:
    ids: np.ndarray
    tokens: np.ndarray  # of all items
    begins: np.ndarray  # n+1 offsets into them
    shapes: list[list[int]]  # offsets that a mask, or a short item, reads
    table: list[tuple[np.ndarray, np.ndarray]]  # for each shape: sorted hashes, and places in tokens
    sieve: np.ndarray  # low 20 bits of the hashes

    @staticmethod
    def of(ids: list, texts: list) -> Block:
        tokens, begins = word_hashes(pa.array(texts, pa.string()))
        sizes = np.diff(begins)
        shapes = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
        shapes += [list(range(n)) for n in sorted({int(n) for n in sizes if 0 < n < SPAN})]
        sieve, table = np.zeros(1 << 20, bool), []
        for k, shape in enumerate(shapes):
            h, at = [], []
            for i, n in enumerate(sizes):
                if n >= SPAN if k < len(MASKS) else n == len(shape):
                    own = seeds(tokens[begins[i] : begins[i + 1]], shape, k)
                    h.append(own)
                    at.append(begins[i] + np.arange(len(own)))
            hashes, places = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (h, at))
            order = np.argsort(hashes, kind="stable")
            table.append((hashes[order], places[order].astype(np.int64)))
            sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return Block(np.array(ids), tokens, begins, shapes, table, sieve)

    def hits(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], list[tuple[int, int]]]]:
        """Distinct (text, item, place in all texts minus place in item) of the seeds that meet, a seed belonging to the
        text that it begins in; and, for words that come again and again in a text and an item, ranges of such differences by (text, item)."""
        found, wide = [np.zeros((0, 3), np.int64)], {}
        for k, (shape, (hashes, places)) in enumerate(zip(self.shapes, self.table)):
            if not len(hashes):
                continue
            h = seeds(tokens, shape, k)
            here = np.flatnonzero(self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(hashes, h[here]), np.searchsorted(hashes, h[here], side="right")
            here, lo, n = here[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if n.sum() > EXPANDED:
                _, own, often = np.unique(lo, return_inverse=True, return_counts=True)
                heavy = often[own] * n > HEAVY
                self._ranges(here[heavy], lo[heavy], n[heavy], places, ends, wide)
                here, lo, n = here[~heavy], lo[~heavy], n[~heavy]
            part = np.cumsum(n) // EXPANDED  # some at a time
            for x in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
                if len(x):
                    m = n[x]
                    at = places[np.repeat(lo[x], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                    item, begin = np.searchsorted(self.begins, at, side="right") - 1, np.repeat(here[x], m)
                    text = np.searchsorted(ends, begin, side="right") - 1
                    found.append(np.unique(np.stack([text, item, begin - (at - self.begins[item])], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0), wide

    def _ranges(self, here: np.ndarray, lo: np.ndarray, n: np.ndarray, places: np.ndarray, ends: np.ndarray, wide: dict) -> None:
        text = np.searchsorted(ends, here, side="right") - 1
        order = np.lexsort((here, text, lo))
        here, lo, n, text = here[order], lo[order], n[order], text[order]
        edges = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (text[1:] != text[:-1]), [True]])) if len(lo) else []
        for a, b in zip(edges, edges[1:]):
            at = np.sort(places[lo[a] : lo[a] + n[a]])
            item = np.searchsorted(self.begins, at, side="right") - 1
            firsts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
            for i, least, most in zip(item[firsts].tolist(), at[firsts].tolist(), at[np.append(firsts[1:], len(at)) - 1].tolist()):
                begin = int(self.begins[i])
                wide.setdefault((int(text[a]), i), []).append((int(here[a]) - most + begin, int(here[b - 1]) - least + begin))

    def verify(self, tokens: np.ndarray, item: int, shift: int) -> tuple[int, int, int] | None:
        """Begin, end (in the document) and agreeing tokens of the best stretch, if it is enough."""
        own = self.tokens[self.begins[item] : self.begins[item + 1]]
        lo, hi = max(0, -shift), min(len(own), len(tokens) - shift)
        if hi <= lo:
            return None
        same = own[lo:hi] == tokens[lo + shift : hi + shift]
        if int(same.sum()) < min(AGREE, len(own)):
            return None
        run = np.cumsum(np.where(same, 1, -2))
        low = np.minimum.accumulate(np.concatenate([[0], run[:-1]]))
        end = int((run - low).argmax()) + 1
        begin = int(np.flatnonzero(np.concatenate([[0], run])[:end] == low[end - 1])[-1])
        for a, b in ((begin, end), (0, hi - lo)):  # near its ends a substitution outweighs what lies beyond: the whole overlap may do
            agree = int(same[a:b].sum())
            if agree >= min(AGREE, len(own)) and agree >= SHARE * (b - a):
                return lo + a + shift, lo + b + shift, agree
        return None

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, begin, end, agreeing tokens): the best match of each text and item, the first one on ties."""
        tokens, ends = word_hashes(column)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def look(text: int, item: int, shift: int) -> None:
            a, b = int(ends[text]), int(ends[text + 1])
            so_far = best.get((text, item), (0, 0, 0))
            if so_far[2] < self.begins[item + 1] - self.begins[item]:  # all of the item agrees: nothing is better
                found = self.verify(tokens[a:b], item, shift - a)
                if found and (found[2] > so_far[2] or found[2] == so_far[2] and found < so_far):
                    best[text, item] = found

        some, wide = self.hits(tokens, ends)
        for text, item, shift in some.tolist():
            look(text, item, shift)
        for (text, item), ranges in wide.items():  # each diagonal once, however many seeds lie on it
            done = min(a for a, _ in ranges)
            for a, b in sorted(ranges):
                for shift in range(max(a, done), b + 1):
                    look(text, item, shift)
                done = max(done, b + 1)
        yield from ((t, i, *m) for (t, i), m in best.items())


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The benchmark, part by part."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).distinct()
    size = F.ceil(F.length("text") / F.lit(2))  # tokens at most
    n = max(1, -(-int(items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) // BLOCK_TOKENS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()  # a block is bounded
        if rows:
            yield Block.of([r["id"] for r in rows], [r["text"] for r in rows])


_SCHEMA = "doc_id long, item_id long, n_agree int, n_overlap int, doc_begin long, doc_end long"


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that it holds: the ids, tokens that agree, length and place (in words) of the stretch."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], _SCHEMA)
    for block in blocks(benchmark, item_col, item_text_col):
        shared = share(spark, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    found = list(block.matches(part.column(1)))
                    if found:
                        text, item, begin, end, agree = map(np.array, zip(*found))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(block.ids[item]), pa.array(agree.astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(begin), pa.array(end)], [c.split()[0] for c in _SCHEMA.split(", ")])

        out = out.unionByName(own.mapInArrow(lean(run), _SCHEMA))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item."""
    for block in blocks(benchmark, item_col, item_text_col):
        shared = share(docs.sparkSession, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col, 1 << 20):
                    clean = np.ones(part.num_rows, bool)
                    clean[[m[0] for m in shared.value.matches(part.column(text_col))]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
