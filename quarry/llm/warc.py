"""WARC archives: a writer, and a reader that salvages what it can of damaged ones.

Writer. Every row is a record. Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest id
is a ``response``, the others are ``revisit`` records that refer to it and carry no payload; what is equal is found by
digests that are counted before they are shuffled, and only payloads whose copies are too many to be broadcast move. Spark's text
sink writes the bytes, so files are committed as a whole, in any store: plain records end with the sink's separator (two line
ends), and the last byte of a gzip member, the highest of its length, is the separator 0 (a record of 16 MB or more
is followed by an empty member, which ends so too). Files are about ``FILE_BYTES`` long.

Reader. A file is a stream of gzip members or of plain records, in any mixture. A record stands only if its member's checksum,
its version line, its length, its end and its declared digests hold. After a failed check the next member or version line
from which a whole record follows is searched for, byte by byte; what lies between is logged as a quarantined gap with the reason, and
all later records are read. Files up to ``INLINE_BYTES`` come through Spark's reader of binary files, larger ones are
streamed from the executors (by Arrow's file systems); of those, one record is held at a time.

Defined cases: a null payload counts as empty; a row without an id is a response unless a copy with an id exists; rows that
repeat both the smallest id and the payload are all responses; a null URL gives no such header, white space and controls in one
are percent-coded; other columns are ignored, whatever their names; an empty table gives no record, an empty file no row. A damaged record whose payload holds another whole
record (or member) gives that one back: nothing tells it from a record of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.common import lean, setting, spool, spread_join, tidied
from quarry.sources.shared import scratch

#: Fixed by the contract: smaller payloads are never revisited.
REVISIT_BYTES = 100
#: Bytes of an archive file, about; digests that go out by broadcast at most; files that Spark reads whole at most.
FILE_BYTES, BROADCAST_DIGESTS, INLINE_BYTES = 32 << 20, 200_000, 64 << 20
#: A record, or what a member holds, may be so long; longer ones are quarantined.
RECORD_BYTES = 1 << 30
STEP = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SMALL_BATCHES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

# ---------------------------------------------------------------- writer


def _urn(of: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(of.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))


def _percent(url: Column) -> Column:
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _headed(rows: DataFrame, date: str) -> DataFrame:
    """Rows (id, url, payload, sha, n, first) to (head, payload): what stands before the payload, and the payload of responses."""
    revisit = F.coalesce(F.col("first") != F.coalesce("id", F.col("first") + 1), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    hexed = F.concat(F.lit("sha256:"), F.lower(F.hex("sha")))
    refers = F.concat(_line("WARC-Refers-To", _urn(F.col("first"))), _line("WARC-Profile", F.lit(_PROFILE)), _line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(http.cast("binary"), 256))))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", _urn(F.col("id"))), _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", _percent(F.col("url"))), F.lit("")), _line("WARC-Payload-Digest", hexed), F.when(revisit, refers).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")), F.lit("\r\n"), http,
    )
    return rows.select(head.alias("head"), F.when(revisit, F.lit("")).otherwise(F.col("payload")).alias("payload"))


def member(record: bytes, level: int) -> bytes:
    """A gzip member that ends with a zero byte, if need be by an empty member after it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(record) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += packer.compress(b"") + packer.flush()
    return out


def _members(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (member(head.as_py().encode() + payload.as_py().encode() + b"\r\n\r\n", level)[:-1] for head, payload in zip(batch.column(0), batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["member"])

    return lean(run)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", level: int = 6) -> None:
    """``pages`` (a numeric id, a URL, a text) as archives in the new ``folder``. ``level`` 0: plain records, else of gzip members."""
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    own = own.withColumn("sha", F.unhex(F.sha2(F.col("payload").cast("binary"), 256))).withColumn("n", F.octet_length("payload").cast("long"))
    digests = spool(own.groupBy("sha").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.count("*").alias("copies")), "warc-digests")
    shared = digests.where((F.col("copies") > 1) & (F.col("n") >= REVISIT_BYTES)).select("sha", "first", "copies")
    records, size, groups = digests.agg(F.sum("copies"), F.sum("n"), F.count_if((F.col("copies") > 1) & (F.col("n") >= REVISIT_BYTES))).first()
    joined = own.join(F.broadcast(shared), "sha", "left") if groups <= BROADCAST_DIGESTS else spread_join(own, shared, ["sha"], "copies", "left")
    rows = _headed(joined, date)
    per_file = max(1, FILE_BYTES * (records or 1) // ((size or 0) + 600 * (records or 1)))
    if level:
        rows, end = rows.mapInArrow(_members(level), "member binary").select(F.col("member").cast("string")), "\0"
    else:
        rows, end = rows.select(F.concat("head", "payload")), "\r\n\r\n"
    with setting(spark, *_SMALL_BATCHES):
        rows.write.option("lineSep", end).option("maxRecordsPerFile", per_file).text(folder)


# ---------------------------------------------------------------- reader

_START = re.compile(rb"WARC/[0-9]\.[0-9]+\r?\n|\x1f\x8b\x08")
_VERSION = re.compile(rb"WARC/[0-9]\.[0-9]+\r?\n")
_FIELD = re.compile(r"[^\s:]+[ \t]*:")
_HEAD_BYTES = 1 << 16


class Damaged(ValueError):
    """What is wrong with the bytes at a place."""


def _member(f, at: int) -> tuple[bytes, int]:
    """What the gzip member at ``at`` holds, and where it ends."""
    f.seek(at)
    unpack, out, size, read = zlib.decompressobj(31), [], 0, 0
    try:
        while not unpack.eof:
            piece = f.read(STEP if read else 1 << 14)
            if not piece:
                raise Damaged("member is cut off")
            read += len(piece)
            while piece and not unpack.eof:  # a step at a time, so that little data can't become much memory
                out.append(unpack.decompress(piece, STEP))
                size += len(out[-1])
                piece = unpack.unconsumed_tail
                if size > RECORD_BYTES:
                    raise Damaged("member is too long")
                if len(out) == 1 and size and not b"WARC/".startswith(out[0][:5]):
                    raise Damaged("member holds no record")
    except zlib.error as e:
        raise Damaged("member is damaged") from e
    return b"".join(out), at + read - len(unpack.unused_data)


def _digest_holds(declared: str, data: bytes) -> bool:
    """Whether ``algorithm:value`` (hex or base 32) is the digest of ``data``; unknown algorithms hold."""
    kind, _, value = declared.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "sha512", "md5"):
        return True
    found = hashlib.new(kind, data, usedforsecurity=False)
    return value.strip().lower() in (found.hexdigest(), base64.b32encode(found.digest()).decode().lower(), base64.b32encode(found.digest()).decode().rstrip("=").lower())


def _fields(lines: bytes, strict: bool = False) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before. ``strict``: other lines,
    such as another record's version line after a cut, aren't passed over."""
    out, name = {}, ""
    for line in re.split(r"\r?\n", lines.decode("utf-8", "replace")):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif _FIELD.match(line):
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
        elif strict and line:
            raise Damaged("header is damaged")
    return out


def _record(f, at: int, size: int) -> tuple[dict, int]:
    """The plain record at ``at`` with its payload, and where it ends."""
    f.seek(at)
    head = f.read(_HEAD_BYTES)
    if not _VERSION.match(head):
        raise Damaged("no version line")
    stop = re.search(rb"\r?\n\r?\n", head)
    if not stop:
        raise Damaged("header has no end")
    fields = _fields(head[: stop.start()].partition(b"\n")[2], strict=True)
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("no length")
    length = int(fields["content-length"])
    if length > RECORD_BYTES:
        raise Damaged("record is too long")
    end = at + stop.end() + length + 4
    if end > size:
        raise Damaged("record is cut off")
    f.seek(at + stop.end())
    block = f.read(length + 4)
    if block[length:] != b"\r\n\r\n":
        raise Damaged("record has no end")
    block = block[:length]
    kind, payload, http = fields.get("warc-type"), block, {}
    if fields.get("content-type", "").startswith("application/http"):
        cut = re.search(rb"\r?\n\r?\n", block)
        http, payload = (_fields(block[: cut.start()]), block[cut.end() :]) if cut else (_fields(block), b"")
    if not _digest_holds(fields.get("warc-block-digest", ""), block):
        raise Damaged("block digest differs")
    if kind != "revisit" and not _digest_holds(fields.get("warc-payload-digest", ""), payload):
        raise Damaged("payload digest differs")
    said = http.get("content-length", "")
    found = {
        "type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "refers_to": fields.get("warc-refers-to"), "declared_digest": fields.get("warc-payload-digest"),
        "payload_bytes": len(payload) if kind != "revisit" else int(said) if re.fullmatch("[0-9]{1,18}", said) else None,
        "payload_sha256": hashlib.sha256(payload).hexdigest() if kind != "revisit" else None, "payload": payload if kind != "revisit" else None,
    }
    return found, end


def _next_start(f, at: int, size: int) -> int:
    """The first place from ``at`` on where a member or a version line may begin; ``size`` if there is none."""
    rest = b""
    f.seek(at)
    while piece := f.read(STEP):
        here = rest + piece
        if found := _START.search(here):
            return at - len(rest) + found.start()
        rest, at = here[-16:], at + len(piece)
    return size


def salvage(f, size: int) -> Iterator[dict]:
    """Records and gaps of a seekable file of ``size`` bytes, in order. A gap has a ``problem``, and no record's fields."""
    at, gap, why = 0, None, ""
    while at < size:
        f.seek(at)
        try:
            if f.read(3) == b"\x1f\x8b\x08":
                data, end = _member(f, at)
                found = [x | {"offset": at, "length": end - at} for x in salvage(io.BytesIO(data), len(data))]  # an inner gap counts as a gap of the member
                if found and all("problem" in x for x in found):
                    raise Damaged(found[0]["problem"])
            else:
                record, end = _record(f, at, size)
                found = [{"offset": at, "length": end - at} | record]
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            at = _next_start(f, at + 1, size)
            continue
        if found and gap is not None:
            yield {"offset": gap, "length": at - gap, "problem": why}
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield {"offset": gap, "length": size - gap, "problem": why}


_COLUMNS = [
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("problem", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()),
    ("refers_to", pa.string()), ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("payload", pa.binary()),
]
_SCHEMA = "file string, offset long, length long, problem string, type string, record_id string, uri string, date string, refers_to string, declared_digest string, payload_bytes long, payload_sha256 string, payload binary"


def _read(payloads: bool):
    def rows(path: str, f, size: int) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for row in salvage(f, size):
            held.append(row | {"file": path} | ({} if payloads else {"payload": None}))
            n += len(held[-1].get("payload") or b"") + 500
            if n >= 4 << 20:
                yield pa.RecordBatch.from_pylist(held, pa.schema(_COLUMNS))
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, pa.schema(_COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, size = batch.column("path")[i].as_py(), batch.column("length")[i].as_py()
                if "content" in batch.schema.names:
                    yield from rows(path, pa.BufferReader(batch.column("content")[i].as_buffer()), size)
                else:
                    from pyarrow import fs

                    store, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                    with store.open_input_file(inner) as f:
                        yield from rows(path, f, size)

    return lean(run)


def read_warc(spark: SparkSession, path: str, payloads: bool = True, inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """Records and quarantined gaps of the archives in ``path`` (a folder, file or pattern): file, offset, length (of the record or its
    member), problem (null for a record), type, record_id, uri, date, refers_to, declared_digest, payload_bytes, payload_sha256, payload
    (null for revisits and where ``payloads`` is false). A revisit's payload_bytes is what its HTTP header says."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= inline_bytes).select("path", "length", "content").mapInArrow(_read(payloads), _SCHEMA)
    return small.unionByName(files.where(F.col("length") > inline_bytes).select("path", "length").mapInArrow(_read(payloads), _SCHEMA))


def records(read: DataFrame) -> DataFrame:
    return read.where("problem IS NULL").drop("problem")


def quarantine(read: DataFrame) -> DataFrame:
    """The log of gaps: file, offset, length, problem."""
    return read.where("problem IS NOT NULL").select("file", "offset", "length", "problem")


def _page_of(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")


@tidied
def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``pages`` written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to. A gap in what was just written is an error."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    common._open[-1].append(lambda: common._delete(spark, folder))
    write_warc(pages, folder, id_col, url_col, payload_col)
    with setting(spark, *_SMALL_BATCHES):
        return spool(
            read_warc(spark, folder, payloads=False).select(
                F.when(F.col("problem").isNull(), _page_of(F.col("record_id"))).otherwise(F.raise_error(F.concat(F.lit("damaged archive: "), F.col("problem")))).alias("page_id"),
                "payload_bytes", F.coalesce("payload_sha256", F.regexp_extract("declared_digest", "^sha256:(.*)$", 1)).alias("payload_digest"),
                F.col("type").alias("record_type"), _page_of(F.col("refers_to")).alias("refers_to"),
            ), "warc-read",
        )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
SELECT page_id, payload_bytes, sha256(payload) AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first END AS refers_to
FROM (SELECT *, coalesce(payload_bytes >= 100 AND first IS DISTINCT FROM page_id, false) AS revisit
      FROM (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""
