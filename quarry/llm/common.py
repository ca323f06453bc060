"""What the operators of this subpackage share: folds, the shared folder, and a vectorised word hasher."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import scratch
from quarry.sources.tables import spread

# ---------------------------------------------------------------- session and shared tables


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[list[Callable[[], None]]] = []  # what the running operators, outer ones first, undo when their result is written


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of a block; the session's own comes back after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffles of the job go when it ends. Inside a ``tidied`` operator the table goes when the operator's result is written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.spool_path = path
    if _open:
        _open[-1].append(lambda: _delete(spark, path))
    return out


@contextlib.contextmanager
def bucketed(df: DataFrame, column: str, buckets: int):
    """``df`` as a table in the shared folder, bucketed by ``column``, for the time of a block: joins on it move the other side only."""
    spark = df.sparkSession
    path = scratch(spark, "bucketed")
    name = "quarry_" + path.rsplit("-", 1)[1]
    with setting(spark, CLEANUP, "true"):
        df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_spool(df: DataFrame) -> None:
    """Delete a spooled table that nothing will read again."""
    _delete(df.sparkSession, df.spool_path)


def share(spark: SparkSession, value):
    """A broadcast; inside a ``tidied`` operator it goes when the operator's result is written."""
    shared = spark.sparkContext.broadcast(value)
    if _open:
        _open[-1].append(shared.destroy)
    return shared


def tidied(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written to the shared folder, and whose own tables and broadcasts go then."""

    @functools.wraps(make)
    def run(*args, **kwargs) -> DataFrame:
        _open.append([])
        try:
            out = make(*args, **kwargs)
            own = _open.pop()
            try:
                return spool(out, make.__name__)  # belongs to the operator outside, if any
            finally:
                _open.append(own)
        finally:
            for undo in _open.pop():
                with contextlib.suppress(Exception):  # the result stands; a leftover does no harm
                    undo()

    return run


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Rows from which on a key's rows may be split; such keys go out by broadcast, so there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 200, 50_000


def spread_join(rows: DataFrame, classes: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (``how``: inner or left) with ``classes``: one row a key, of which ``count`` says how many rows have it. ``keys`` hold no null.

    Rows of frequent keys are not gathered: their classes, at most HOT_KEYS since each has a HOT_KEYS-th of all rows, are
    broadcast. Both tables are read twice, so they should be written ones."""
    total, most = classes.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    least = max(HOT_ROWS, -(-int(total) // HOT_KEYS))
    if most < least:
        return rows.join(classes, keys, how)
    hot, cold = classes.where(F.col(count) >= least), classes.where(F.col(count) < least)
    few = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return few.unionByName(rows.join(F.broadcast(hot), keys))


def crc_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; texts will reach Python in small batches."""
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# ---------------------------------------------------------------- what Python workers keep

_held: dict = {}


def held(key: tuple, make: Callable):
    """The tools of an operator, which a worker keeps from task to task; it keeps those of one operator at a time."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of other operators' tools and give free memory back; for functions that need it."""
    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Give free memory back to the system, so that a worker that waits holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """For functions of mapInArrow and mapInPandas: a worker lets go of other operators' tools before, and of free memory after."""

    @functools.wraps(run)
    def wrapped(batches):
        release()
        yield from run(batches)
        trim()

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of 4 MB at most (one text at least), so a worker's memory doesn't follow the rows' number."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


# ---------------------------------------------------------------- word hashing

#: Bytes hashed at a time; longer words widen one step. Words of more bytes than LONG_WORD are hashed one by one.
CHUNK, LONG_WORD = 1 << 18, 512
#: Multipliers; the first holds a blank, so no eight bytes of a word cancel it.
_KEYS = np.array([0x9E20C15F39CC0605, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _folded_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit products, one over the other: no polynomial, so words of a pattern don't meet."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    al, ah, bl, bh = a & low, a >> half, b & low, b >> half
    with np.errstate(over="ignore"):
        ll, lh, hl = al * bl, al * bh, ah * bl
        middle = (ll >> half) + (lh & low) + (hl & low)
        return ((ll & low) | (middle << half)) ^ (ah * bh + (lh >> half) + (hl >> half) + (middle >> half))


def _hashed(piece: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the words at ``starts`` of folded bytes, eight bytes a step."""
    out = np.full(len(starts), _KEYS[1], dtype=np.uint64)
    padded = np.concatenate([piece, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    long = sizes > LONG_WORD
    live = np.flatnonzero(~long)
    at, left, h = starts[live], sizes[live], out[live]
    while len(live):
        block = eights[at] & _TAIL[np.minimum(left, 8)]
        h = _folded_product(block ^ _KEYS[0], h ^ _KEYS[2])
        more = left > 8
        out[live[~more]] = h[~more]
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(long):
        out[i] = int.from_bytes(hashlib.blake2b(piece[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
    with np.errstate(over="ignore"):
        return mix(out + sizes.astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lower-cased, and n+1 offsets into them."""
    raw, ends = text_bytes(column)
    hashes, starts_at = [], []
    lo, total = 0, len(raw)
    edge = np.zeros(total + 1, dtype=bool)
    edge[ends] = True
    while lo < total:
        hi = min(lo + CHUNK, total)
        while hi < total:  # a chunk ends with a separator or a text
            near = _SPACE[raw[hi : hi + 65536]] | edge[hi : hi + 65536][: min(65536, total - hi)]
            if near.any():
                hi += int(near.argmax())
                break
            hi = min(hi + 65536, total)
        piece = raw[lo:hi]
        inside = ~_SPACE[piece]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[lo + 1 : hi]
        last[:-1] &= ~inside[1:] | edge[lo + 1 : hi]
        starts = np.flatnonzero(first)
        if len(starts):
            hashes.append(_hashed(_FOLD[piece], starts, np.flatnonzero(last) + 1 - starts))
            starts_at.append(starts + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), ends)


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20, rows: int = 1 << 30):
    """Parts of a batch of about ``limit`` bytes of text each (one text at least) and at most ``rows`` rows, to bound temporary arrays."""
    size = np.asarray(pc.binary_length(batch.column(text).cast(pa.large_string())).fill_null(0))
    group = np.cumsum(size) // limit
    cuts = sorted({0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), *range(0, len(size), rows), len(size)})
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def semi(left: DataFrame, ids: DataFrame, column: str, broadcast_rows: int = 1_000_000, how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` whose ``column`` is in ``ids`` (null matches null), or with ``left_anti`` the others. ``ids`` goes
    out by broadcast only when its counted rows are at most ``broadcast_rows``; else both sides are shuffled."""
    (other,) = free(left, "_semi")
    ids = ids.select(F.col(column).alias(other)).distinct()
    if ids.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    return left.join(ids, left[column].eqNullSafe(F.col(other)), how)
