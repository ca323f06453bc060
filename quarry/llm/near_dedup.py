"""Near-duplicate detection: MinHash bands find candidates, sequential Bayesian verification prunes them, full sets decide.

1. Each text becomes its set of 5-word shingles and a signature of 128 minima. Texts with one set are one class.
2. Signatures are cut into 32 bands of 4. In the buckets of the first bands all members are compared with the smallest
   one (a star), never each with each; verified links give first components. Then members of the buckets that still
   hold several components are put in a few random orders and neighbours are compared (chains), which joins what the
   stars left apart in big groups.
3. Buckets whose members still lie in different components are compared further: all pairs across components, in blocks
   of bounded size and with the full sets at hand, giving one link for each text and component at most. A big group of
   near copies is one component by now and costs little, and no link between components is lost.
4. A comparison reads the signatures batch by batch and stops once the posterior probability of a similarity of
   ``threshold`` or more falls below ``MISS``. Survivors are confirmed on their full sets.
5. Components come from alternating large and small stars over the links, written to the shared folder each round.

A pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6, and less above.

Defined cases: a text without words has an empty set and links with nothing; fewer than five words are one shingle;
rows that repeat an id are one document: if their texts differ, the one whose set has the smallest digest stands for it
in every step, and all its rows get its component (``n_shingles`` is each row's own); a row with a null id links with
nothing, has a null component and is kept; an empty table gives no row; very long texts have all
their shingles, one text at a time; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, drop_spool, lean, mix, semi, slices, spool, spread_join, tidied, word_hashes

WORDS, ROWS, BANDS, FIRST_BANDS = 5, 4, 32, 3
HASHES, BATCH = ROWS * BANDS, 16
#: Posterior probability below which a pair is dropped; members and bytes of sets in a comparison block; rounds of chains.
MISS, BLOCK, BLOCK_BYTES, CHAINS = 1e-6, 1024, 64 << 20, 3

_rng = np.random.default_rng(11)
_ODD = _rng.integers(1, 1 << 63, HASHES, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_XOR = _rng.integers(1, 1 << 63, HASHES, dtype=np.int64).astype(np.uint64)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def shingle_set(tokens: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text's word hashes."""
    n = len(tokens)
    with np.errstate(over="ignore"):
        if n < WORDS:
            return mix(np.array([sum(int(t) * int(p) for t, p in zip(tokens, _PLACE)) + n & (1 << 64) - 1], np.uint64)) if n else np.zeros(0, np.uint64)
        h = np.zeros(n - WORDS + 1, np.uint64)
        for i, p in enumerate(_PLACE):
            h += tokens[i : n - WORDS + 1 + i] * p
        return np.unique(mix(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 minima of 32 bits."""
    out = np.full(HASHES, (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1024):
            part = shingles[i : i + 1024]
            np.minimum(out, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


@lean
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            tokens, ends = word_hashes(part.column(1))
            n, set_id, sig = [], [], []
            for a, b in zip(ends, ends[1:]):
                shingles = shingle_set(tokens[a:b])
                n.append(len(shingles))
                set_id.append(_digest(shingles) if len(shingles) else None)
                sig.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(set_id, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "set_id", "sig"])


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            tokens, ends = word_hashes(part.column(1))
            sets = [shingle_set(tokens[a:b]) for a, b in zip(ends, ends[1:])]
            some = [i for i, x in enumerate(sets) if len(x)]  # an empty text of a repeated id stands for nothing
            sets = [sets[i] for i in some]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some, pa.int64())), pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "set_id", "set"])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


@lean
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            sig = _signatures(part.column(1)).astype(np.uint64)
            keys = np.zeros((len(sig), BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(ROWS):
                    keys = mix(keys + sig[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            band = np.tile(np.arange(BANDS, dtype=np.int16), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(band), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS))], ["key", "band", "rep"])


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """After n compared hashes, the matches below which P(similarity >= threshold), under a flat prior, is below ``miss``."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:  # the posterior is a sum of binomial terms
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two signature tables stay possible, comparing batch by batch only those that still are."""
    live, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in least_matches(threshold):
        matches[live] += (a[live, n - BATCH : n] == b[live, n - BATCH : n]).sum(axis=1)
        live = live[matches[live] >= least]
    return live


def _prune(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                live = pa.array(survivors(_signatures(batch.column(2)), _signatures(batch.column(3)), threshold))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(live), batch.column(1).take(live)], ["a", "b"])

    return lean(run)


def _confirm(threshold: float):
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    good.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return lean(run)


def _sets_of(ids: DataFrame, own: DataFrame, twice: DataFrame) -> DataFrame:
    """(id, set) of the documents in ``ids`` (doc_id); ``twice`` has the set that counts of ids with several."""
    sets = semi(own, ids, "doc_id").mapInArrow(_sets, "id long, set_id binary, set binary")
    if not twice.isEmpty():
        sets = sets.join(_small(twice.withColumnRenamed("doc_id", "id")), "id", "left").where("chosen is null or chosen = set_id").drop("chosen")
    return spool(sets.select("id", "set").dropDuplicates(["id"]), "nd-sets")


def _small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """For broadcast if it has that few rows, by count."""
    return F.broadcast(df) if df.count() <= rows else df


def _verified(pairs: DataFrame, own: DataFrame, twice: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sets = _sets_of(spool(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "nd-ids"), own, twice)
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    links = spool(pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(threshold), "a long, b long"), "nd-links")
    drop_spool(sets)
    return links


def _similar(one: np.ndarray, others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets are similar enough to one set, exactly."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    both = np.add.reduceat((one[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * both >= round(threshold * 100) * (sizes + len(one) - both)


def _block_links(rep: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], part: np.ndarray, i: int, j: int, threshold: float) -> list[tuple[int, int]]:
    """Links between components in a block of a bucket: of part i with part j, one for each row and component at most."""
    rows = np.flatnonzero(part == i)
    others = rows if i == j else np.flatnonzero(part == j)
    if len(others) < len(rows):
        rows, others = others, rows
    out = []
    for x in rows:
        y = others[(comp[others] != comp[x]) & (np.minimum(n[others], n[x]) >= threshold * np.maximum(n[others], n[x]))]
        y = y[rep[y] > rep[x]] if i == j else y
        y = y[survivors(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y], threshold)] if len(y) else y
        if len(y):
            y = y[_similar(sets[x], [sets[k] for k in y], threshold)]
            _, first = np.unique(comp[y], return_index=True)
            out += [(min(rep[x], rep[k]), max(rep[x], rep[k])) for k in y[first]]
    return out


_BLOCK = ["key", "i", "j", "part", "rep", "comp", "n", "sig", "set"]


def _across(threshold: float):
    """Blocks lie one after the other in a partition; only the one that is open is held."""

    def links(batch: pa.RecordBatch, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, part, rep, comp, n = (np.asarray(batch.column(k)) for k in range(1, 7))
        sig, raw = _signatures(batch.column(7)), batch.column(8).cast(pa.large_binary())
        offsets, data = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1], np.frombuffer(raw.buffers()[2], np.uint8)
        sets = [data[a:b].view(np.uint64) for a, b in zip(offsets, offsets[1:])]
        out = []
        for a, b in zip(begins, [*begins[1:], batch.num_rows]):
            out += _block_links(rep[a:b], comp[a:b], n[a:b], sig[a:b], sets[a:b], part[a:b], i[a], j[a], threshold)
        ends = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)])
            new = np.flatnonzero(np.concatenate([[last is None or (key[:, 0] != last).any()], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            last = key[:, -1]
            if not len(new):
                held.append(batch)
                continue
            if held:
                yield from links(pa.concat_batches([*held, batch.slice(0, int(new[0]))]), np.zeros(1, np.int64))
            if len(new) > 1:
                yield from links(batch.slice(int(new[0]), int(new[-1] - new[0])), new[:-1] - new[0])
            held = [batch.slice(int(new[-1]))]
        if held:
            yield from links(pa.concat_batches(held), np.zeros(1, np.int64))

    return lean(run)


@lean
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, block by block, as stars: every end with the smallest it can reach."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = root(u), root(v)
            parent[max(p, q)] = min(p, q)
        out = [(x, root(x)) for x in list(parent)]
        ends = np.array([o for o in out if o[0] != o[1]], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(u, v) for every document that can reach a smaller id; v is the smallest one. Links are (u, v) either way round.

    Alternating large and small stars, after each partition has shortened what it holds; done when no end has two parents
    or a parent that has one."""
    edges = spool(links.select("u", "v").mapInArrow(_forest, "u long, v long").distinct(), "cc")
    while True:
        both = edges.select("u", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        if both.groupBy("u").agg(F.sum("o").alias("o"), F.max("i").alias("i")).where("o > 1 or o = 1 and i = 1").isEmpty():
            return edges
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        following = spool(small, "cc")
        drop_spool(edges)
        edges = following


@tidied
def near_duplicates(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = spool(own.mapInArrow(_sketch, "doc_id long, n long, set_id binary, sig binary"), "nd-sketch")
    linked = sketch.where("n > 0 and doc_id is not null")
    twice = spool(linked.groupBy("doc_id").agg(F.min("set_id").alias("chosen"), F.max("set_id").alias("last")).where("chosen != last").drop("last"), "nd-twice")
    named = sketch
    if not twice.isEmpty():
        named = sketch.join(_small(twice), "doc_id", "left").withColumn("own", F.coalesce(F.col("chosen") == F.col("set_id"), F.col("chosen").isNull())).withColumn("set_id", F.coalesce("chosen", "set_id"))
        linked = named.where("n > 0 and doc_id is not null and own")
    classes = spool(linked.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig")), "nd-classes")
    reps = classes.select("rep", "n", "sig")

    bands = spool(reps.select("rep", "sig").mapInArrow(_bands, "key long, band short, rep long"), "nd-bands")
    leads = spool(bands.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count("*").alias("m")).where("lead != last").select("key", "lead", "m"), "nd-leads")
    members = spool(spread_join(bands, leads, ["key"], "m").drop("m"), "nd-members")
    drop_spool(bands)
    left, right = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))

    def likely(pairs: DataFrame) -> DataFrame:
        return spool(pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(threshold), "a long, b long"), "nd-likely")

    def placed_by(stars: DataFrame, among: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components."""
        placed = spool(among.join(stars.select(F.col("u").alias("rep"), F.col("v").alias("comp")), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp")), "nd-where")
        mixed = spool(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo != hi").select("key", "m"), "nd-mixed")
        return spool(spread_join(placed, mixed, ["key"], "m"), "nd-placed")

    as_edges = lambda pairs: pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    star = members.where((F.col("band") < FIRST_BANDS) & (F.col("rep") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    stars = components(as_edges(_verified(likely(spool(star, "nd-star")), own, twice, threshold)))
    placed = placed_by(stars, members.select("key", "rep"))
    if not placed.isEmpty():
        near = []
        for turn in range(CHAINS):
            dealt = placed.withColumn("o", F.xxhash64("rep", "key", F.lit(turn))).withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / 4096)))
            w = Window.partitionBy("key", "part").orderBy("o", "rep")  # some thousand members
            pairs = dealt.select("rep", "comp", F.lead("rep").over(w).alias("b"), F.lead("comp").over(w).alias("c")).where("comp != c")
            near.append(pairs.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")))
        chains = spool(reduce(DataFrame.unionByName, near).distinct(), "nd-chains")
        stars = components(stars.unionByName(as_edges(_verified(likely(chains), own, twice, threshold))))
        placed = placed_by(stars, placed.select("key", "rep"))

    if not placed.isEmpty():
        sets = _sets_of(placed.select(F.col("rep").alias("doc_id")), own, twice).withColumnRenamed("id", "rep")
        sized = spool(placed.join(reps.select("rep", "n"), "rep"), "nd-sized")
        parts = spool(sized.groupBy("key").agg(F.greatest(F.ceil(F.max("m") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("parts"), F.count("*").alias("rows")), "nd-parts")
        rows = spread_join(sized, parts, ["key"], "rows").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        blocks = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
        blocks = blocks.join(reps.select("rep", "sig").join(sets, "rep"), "rep").select(*_BLOCK)
        more = spool(blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_across(threshold), "a long, b long").distinct(), "nd-more")
        stars = stars if more.isEmpty() else components(stars.unionByName(as_edges(more)))
    comps = stars.select(F.col("u").alias("rep"), F.col("v").alias("comp"))

    placing = spool(classes.select("set_id", "rep", "size").join(comps, "rep", "left").where("size > 1 or comp is not null").select("set_id", F.coalesce("comp", "rep").alias("comp"), "size"), "nd-placing")
    found = named.where("set_id is not null and doc_id is not null").select("doc_id", "n", "set_id")
    rest = named.where("set_id is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("comp"))
    out = spread_join(found, placing, ["set_id"], "size", "left").select("doc_id", "n", F.coalesce("comp", "doc_id").alias("comp")).unionByName(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of the document that stays of each component."""
    gone = near_duplicates(docs, threshold, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col))
    return semi(docs, gone, id_col, how="left_anti")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
