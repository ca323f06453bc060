"""Exact deduplication by exchange of Golomb-coded fingerprints.

1. Every scan partition (a sender) hashes its texts, in blocks, sorts the distinct 48-bit fingerprints of a block, and sends
   each owner (a fingerprint range) one Golomb-Rice coded run of gaps. Digests and ids stay in the sender's block, in a table
   that is bucketed by block.
2. An owner decodes the runs, finds fingerprints that several blocks hold, and returns one bitmap per run. The bitmaps
   go back to the blocks: they are shuffled to the table's buckets, the digests aren't.
3. Only suspects (set bits, and copies inside one block) go on: their texts are grouped by their bytes, so copies
   merge before the shuffle and no group meets in one task.

Defined cases: null text counts as empty; rows with a null id take part and never stay while another copy has an id;
repeated rows count one by one in ``group_size``, but rows that repeat both id and text are one document, so if it is
the one that stays, all of them are ``kept``, and so are copies none of which has an id; an empty table gives an empty
result; very long texts are hashed whole and meet by their bytes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bucketed, documents, lean, semi, spool, spread_join, tidied

BITS = 48
#: Rows of a sender's block and, about, fingerprints of an owner; they bound memory.
SENDER_ROWS, OWNER_ROWS = 250_000, 2_000_000


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes]:
    """Rice parameter and bits of the gaps of sorted distinct ``values``, all below ``span``."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    k = max(0, int(np.log2(max(1.0, 0.69 * span / max(1, len(values))))))
    quotient, rest = (gaps >> k).astype(np.int64), gaps & ((1 << k) - 1)
    starts = np.cumsum(quotient + 1 + k) - (quotient + 1 + k)
    bits = np.zeros(int((quotient + 1 + k).sum()), dtype=np.uint8)
    bits[starts + quotient] = 1  # quotient zeros, then a one, then k bits
    for b in range(k):
        bits[starts + quotient + 1 + b] = (rest >> (k - 1 - b)) & 1
    return k, np.packbits(bits).tobytes()


def golomb_decode(blob: bytes, k: int, n: int) -> np.ndarray:
    """The ``n`` sorted values of ``golomb_encode``."""
    bits = np.unpackbits(np.frombuffer(blob, dtype=np.uint8))
    ones = np.flatnonzero(bits)
    stops, at, i = np.empty(n, np.int64), 0, 0
    if k == 0:
        stops = ones[:n]
    else:
        after = np.searchsorted(ones, np.arange(0, len(bits) + k + 2))  # first one at or after a bit
        after = after.tolist()
        where = ones.tolist()
        for i in range(n):
            stop = where[after[at]]
            stops[i] = stop
            at = stop + 1 + k
    begins = np.concatenate([[0], stops[:-1] + 1 + k])
    rest = np.zeros(n, np.int64)
    for b in range(k):
        rest = (rest << 1) | bits[stops + 1 + b]
    return np.cumsum(((stops - begins) << k) | rest)


_PACKED = "block long, owner int, n int, k int, code binary, ids array<long>, slots array<int>, shas binary, local binary"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]


def _send(owners: int):
    span = -(-(1 << BITS) // owners)

    def pack(ids: pa.Array, shas: np.ndarray, block: int) -> pa.RecordBatch:
        prints = np.zeros(len(ids), np.int64)
        for j in range(BITS // 8):
            prints = (prints << 8) | shas[:, j]
        own, slots, counts = np.unique(prints, return_inverse=True, return_counts=True)
        rows = [(block, -1, len(own), 0, None, ids.to_pylist(), slots.tolist(), shas.tobytes(), np.packbits(counts > 1).tobytes())]
        owner = own // span
        edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
        for a, b in zip(edges, edges[1:]):
            o = int(owner[a])
            k, code = golomb_encode(own[a:b] - o * span, span)
            rows.append((block, o, int(b - a), k, code, None, None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], [c.split()[0] for c in _PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, TaskContext.get().partitionId() << 24

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            raw = whole.column(1).combine_chunks().cast(pa.binary(32)).buffers()[1]
            return pack(whole.column(0).combine_chunks(), np.frombuffer(raw, np.uint8)[: 32 * n].reshape(-1, 32), block)

        for batch in batches:
            for i in range(0, batch.num_rows, SENDER_ROWS):
                held.append(batch.slice(i, SENDER_ROWS))
                n += held[-1].num_rows
                if n >= SENDER_ROWS:
                    yield flush()
                    held, n, block = [], 0, block + 1
        if n:
            yield flush()

    return lean(run)


def _own(runs: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps, one per run, of the fingerprints that some other run has too."""
    values = [golomb_decode(c, k, n) for c, k, n in zip(runs.code, runs.k, runs.n)]
    every, inverse, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = (counts > 1)[inverse]
    cuts = np.cumsum(runs.n.to_numpy())[:-1]
    return pd.DataFrame({"block": runs.block, "owner": runs.owner, "n": runs.n, "bitmap": [np.packbits(x).tobytes() for x in np.split(shared, cuts)]})


def _receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's rows with their digests, and whether they are suspects."""
    for batch in batches:
        for i in range(batch.num_rows):
            n, slots, shas, local, bitmaps = (batch.column(c)[i] for c in ("n", "slots", "shas", "local", "bitmaps"))
            flagged = np.unpackbits(np.frombuffer(local.as_py(), np.uint8), count=n.as_py())
            flagged |= np.concatenate([np.unpackbits(np.frombuffer(x["bitmap"], np.uint8), count=x["n"]) for x in sorted(bitmaps.as_py(), key=lambda x: x["owner"])])
            suspect = flagged[np.asarray(slots.values)].astype(bool)
            digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(suspect), [None, pa.py_buffer(shas.as_py())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, digests, pa.array(suspect)], ["doc_id", "sha", "suspect"])


@tidied
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. ``owners`` is the number of fingerprint ranges (by default one for
    every OWNER_ROWS rows)."""
    spark = docs.sparkSession
    n = docs.count()
    owners = owners or max(1, -(-n // OWNER_ROWS))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    with bucketed(own.select("doc_id", sha.alias("sha")).mapInArrow(_send(owners), _PACKED), "block", max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // OWNER_ROWS))) as packed:
        bitmaps = packed.where("owner >= 0").select("block", "owner", "n", "k", "code").groupBy("owner").applyInPandas(_own, "block long, owner int, n int, bitmap binary")
        back = bitmaps.groupBy("block").agg(F.collect_list(F.struct("owner", "n", "bitmap")).alias("bitmaps"))
        rows = packed.where("owner < 0").select("block", "n", "ids", "slots", "shas", "local").join(back, "block")
        marked = spool(rows.mapInArrow(lean(_receive), "doc_id long, sha binary, suspect boolean"), "exact-marked")
    suspects = marked.where("suspect").select("doc_id", "sha")
    texts = semi(own, suspects, "doc_id").select("doc_id", "text", sha.alias("sha"))
    # grouped by the bytes themselves: copies merge on the map side, and a shared hash alone never joins two texts
    same = texts.groupBy("sha", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("text")
    one = F.when(F.count("*") == 1, F.max("keep_id")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")))
    classes = spool(same.groupBy("sha").agg(one.alias("keep_id"), F.max("group_size").alias("group_size")), "exact-classes")
    rows = spread_join(suspects, classes, ["sha"], "group_size").select("doc_id", "keep_id", "group_size", "sha").unionByName(
        marked.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    )
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size, sha256(coalesce(text, '')) AS text_sha256
  FROM documents)
"""
