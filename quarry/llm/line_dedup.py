"""Deletion of repeated runs of lines, by a suffix array over line ids.

Suffixes are ranked by distributed prefix doubling: the rank of the first 2^(k+1) lines of a suffix comes from the pair
(rank of its first 2^k lines, rank of the 2^k lines after those). Ranks rise in the order of the suffix array, and equal
ranks are an interval of it with a common prefix of 2^k lines or more. Windows that occur once leave at once, so later
rounds hold repeated lines only.

A line goes if it lies in a run of consecutive lines of one document with at least ``min_words`` words together that
occurs earlier, in the order of (doc_id, line), without overlapping that earlier copy. Every suffix that reaches
``min_words`` asks for the interval whose common prefix holds that many words: that prefix is the window which is minimal
from its first line. As the array of suffixes alone would miss the last lines of a run, windows that are minimal from
their last line are asked for too. Two ranks of a round name a window of any length between 2^k and 2^(k+1) - 1 lines.
In each interval the first place is the first copy, the others are later ones; windows of later copies that touch make
up the maximal repeated runs, which are deleted. The first copy of each line always stays.

Line ids are 128-bit digests, which tell the lines of any corpus apart; all steps after them compare ranks.

Defined cases: a null text has no lines and stays null; empty texts stay; lines are cut at ``\\n`` only; rows with a null
id come last; rows that repeat both id and text are the same place, so they get the same result; very long texts are cut
whole, and each of their lines is a row; an empty table gives none; columns called like the two new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, drop_spool, free, lean, slices, spool, spread_join, tidied

#: Words that a run must have; bytes of deletions that may be broadcast at most.
MIN_WORDS, BROADCAST_BYTES = 50, 32 << 20


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, "text", 1 << 20)):
            rows, ids, words = [], [], []
            known: dict[str, tuple[bytes, int]] = {}
            for i, text in enumerate(part.column(2).to_pylist()):
                found = []
                for line in text.split("\n"):
                    if (pair := known.get(line)) is None:
                        pair = known[line] = (hashlib.blake2b(line.encode(), digest_size=16).digest(), len(line.split()))
                    found.append(pair)
                if sum(n for _, n in found) >= least:
                    rows.append(i)
                    ids.append([x for x, _ in found])
                    words.append([n for _, n in found])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(ids, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int32()))], ["doc_id", "th", "ids", "words"])

    return lean(run)


def _ranked(windows: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys that occur at least twice, how often, and their rank in the order of the suffix array."""
    counted = windows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return spool(counted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "sa-intervals")


def minimal_windows(words: np.ndarray, piece: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and lines of the windows with ``least`` words that are minimal from one of their ends, within pieces."""
    end = np.cumsum(words, dtype=np.int64)
    start = end - words
    here = np.arange(len(words))
    last = np.searchsorted(end, start + least)
    ok = last < len(words)
    ok[ok] &= piece[last[ok]] == piece[here[ok]]
    first = np.searchsorted(start, end - least, side="right") - 1
    good = first >= 0
    good[good] &= piece[first[good]] == piece[here[good]]
    both = np.unique(np.stack([np.concatenate([here[ok], first[good]]), np.concatenate([last[ok], here[good]])]), axis=1)
    return both[0], both[1] - both[0] + 1


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            live = batch.column(1)
            flat = live.flatten()
            pos, words, stretch = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(live.offsets)))
            new = np.ones(len(pos), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (stretch[1:] != stretch[:-1])
            at, size = minimal_windows(words, np.cumsum(new), least)
            level = np.array([n.bit_length() - 1 for n in size.tolist()], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[at])), pa.array(pos[at].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(level)], ["d", "start", "size", "level"])

    return lean(run)


@tidied
def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The maximal runs that go: doc_id, th (hash of the text), begin, end (numbers of lines, from 0, end excluded)."""
    least = max(1, min_words)
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    lines = spool(own.mapInArrow(_lines(least), "doc_id long, th long, ids array<binary>, words array<int>").withColumn("row", F.monotonically_increasing_id()), "sa-lines")

    # lines that occur at least twice, in stretches of enough words
    each = lines.select("row", F.posexplode(F.arrays_zip("ids", "words")).alias("pos", "x")).select("row", "pos", F.col("x.ids").alias("id"), F.col("x.words").alias("w"))
    live = spread_join(each, _ranked(each, "id"), ["id"], "n").select("row", "pos", "w", "rank")
    stretches = live.withColumn("g", F.col("pos") - F.row_number().over(Window.partitionBy("row").orderBy("pos")))
    enough = spool(stretches.withColumn("all", F.sum("w").over(Window.partitionBy("row", "g"))).where(F.col("all") >= least).drop("all"), "sa-live")

    # documents by number, in order; repeated rows are one
    order = (F.col("doc_id").asc_nulls_last(), F.col("th"))
    kept = lines.select("row", "doc_id", "th").join(enough.select("row").distinct(), "row").groupBy("doc_id", "th").agg(F.min("row").alias("row"))
    known = spool(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("d", F.monotonically_increasing_id()), "sa-docs")
    placed = spool(enough.join(known.select("row", "d"), "row").select("d", "pos", "w", "g", "rank"), "sa-ranks")
    drop_spool(enough)

    arrays = placed.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("pos", "w", "g"))).alias("live"))
    wanted = spool(arrays.mapInArrow(_windows(least), "d long, start int, size int, level int"), "sa-windows")
    top = wanted.agg(F.max("level")).first()[0]
    ranks, found = placed.select("d", "pos", "rank"), []
    for level in range(top + 1 if top is not None else 0):
        if level:  # doubled: windows of 2^level lines
            along, step = Window.partitionBy("d").orderBy("pos"), 1 << level - 1
            pairs = ranks.select("d", "pos", F.col("rank").alias("a"), F.lead("rank", step).over(along).alias("b"), F.lead("pos", step).over(along).alias("p")).where(F.col("p") == F.col("pos") + step).drop("p")
            pairs = spool(pairs, "sa-pairs")
            doubled = spool(spread_join(pairs, _ranked(pairs, "a", "b"), ["a", "b"], "n").select("d", "pos", "rank"), "sa-ranks")
            drop_spool(pairs)
            ranks = doubled
        asked = wanted.where(F.col("level") == level).withColumn("off", F.col("start") + F.col("size") - (1 << level))
        a, b = ranks.select("d", F.col("pos").alias("start"), F.col("rank").alias("a")), ranks.select("d", F.col("pos").alias("off"), F.col("rank").alias("b"))
        found.append(spool(asked.join(a, ["d", "start"]).join(b, ["d", "off"]).select("d", "start", "size", "a", "b"), "sa-named"))
    if not found:
        return known.select("doc_id", "th", F.lit(0).alias("begin"), F.lit(0).alias("end")).where("false")

    named, interval, place = reduce(DataFrame.unionByName, found), ["size", "a", "b"], F.struct("d", "start")
    copies = spool(named.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "sa-copies")
    overlapping = (F.col("d") == F.col("first.d")) & (F.col("start") - F.col("first.start") < F.col("size"))
    later = spread_join(named, copies, interval, "n").where((place > F.col("first")) & ~overlapping).select("d", "start", (F.col("start") + F.col("size")).alias("stop"))
    # windows that touch are one run
    along = Window.partitionBy("d").orderBy("start", "stop")
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(along))
    runs = runs.groupBy("d", "run").agg(F.min("start").alias("begin"), F.max("stop").alias("end"))
    return runs.join(known, "d").select("doc_id", "th", "begin", "end")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str] = ("n_lines_gone", "lines_gone")) -> DataFrame:
    """``docs`` with shortened texts; two more columns: the number of lines that went, and theirs (null where nothing goes)."""
    number, which = added
    docs = docs.drop(*added)
    d, t = free(docs, "_d", "_t")
    gone = F.array_sort(F.flatten(F.collect_list(F.sequence("begin", F.col("end") - 1))))
    marks = repeated_runs(docs, min_words, id_col, text_col).groupBy("doc_id", "th").agg(gone.alias(which)).withColumnsRenamed({"doc_id": d, "th": t})
    if (marks.agg(F.sum(F.size(which) * 4 + 40)).first()[0] or 0) <= BROADCAST_BYTES:
        marks = F.broadcast(marks)
    out = docs.join(marks, F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text_col) == F.col(t)), "left").drop(d, t)
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(which)), lambda i: F.get(lines, i)), "\n")
    return out.withColumn(text_col, F.when(F.col(which).isNull(), F.col(text_col)).otherwise(left)).withColumn(number, F.coalesce(F.size(which), F.lit(0)).cast("int"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines_gone", "lines_gone")
