"""Archives: an exact round trip, damage of every kind, and the SQL on the smallest tables."""

import gzip
import hashlib
import io
import os
import random
from collections import Counter
from pathlib import Path

import pytest

from quarry.llm import warc

TRICKY = "x" * 90 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a/1", "short"), (2, "http://a/2", "short"), (3, "http://a/3", None), (4, None, ""), (5, "http://a/ü\r\nX: y", TRICKY), (6, "http://a/6", TRICKY), (-7, "http://a/7", "z" * 100),
    (8, "http://a/8", "z" * 100), (9, "u", "z" * 99), (10, "u", "z" * 99), (None, "u", TRICKY), (None, "u", "only without id " * 20), (11, "u", "twice " * 30), (11, "u", "twice " * 30),
]


def expected(pages):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        keep = first.get(html or "")
        revisit = len(data) >= 100 and keep is not None and keep != i
        out[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None] += 1
    return out


@pytest.mark.parametrize("broadcast", [0, 100])
def test_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    rnd = random.Random(3)
    pages = PAGES + [(i, f"http://b/{i}", "same page " * 40 if i % 3 else "".join(rnd.choices("abcü \n", k=300))) for i in range(100, 400)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, sha string, first string").repartition(3)
    assert Counter(map(tuple, warc.archive_round_trip(df).collect())) == expected(pages)
    assert warc.archive_round_trip(df.where("false")).count() == 0


@pytest.mark.parametrize("level", [0, 6])
def test_payloads_and_headers_come_back(spark, tmp_path, level):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, f"{tmp_path}/a", level=level)
    rows = warc.read_warc(spark, f"{tmp_path}/a").collect()
    assert not [r for r in rows if r["problem"]]
    at = {r["record_id"]: r for r in rows if r["record_id"] != "<urn:page:>"}
    assert at["<urn:page:5>"]["payload"].decode() == TRICKY and at["<urn:page:5>"]["uri"] == "http://a/ü%0D%0AX:%20y"
    assert at["<urn:page:6>"]["payload"] is None and at["<urn:page:6>"]["refers_to"] == "<urn:page:5>"
    assert at["<urn:page:4>"]["uri"] is None and at["<urn:page:4>"]["payload"] == b""
    streamed = warc.read_warc(spark, f"{tmp_path}/a", inline_bytes=0).collect()
    assert Counter(map(str, streamed)) == Counter(map(str, rows))
    data = next(Path(f"{tmp_path}/a").glob("part-*")).read_bytes()
    if level:  # any reader of concatenated members reads it
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: re") == len(PAGES) + sum(r["type"] == "response" and r["payload"] == TRICKY.encode() for r in rows)


def test_files_are_bounded_and_a_large_record_ends_with_a_zero(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    warc.write_warc(spark.createDataFrame([(i, "u", f"{i} " * 1000) for i in range(60)], "page_id long, url string, html string").coalesce(1), f"{tmp_path}/b", level=0)
    sizes = [p.stat().st_size for p in Path(f"{tmp_path}/b").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) < 40_000
    big = random.Random(1).randbytes(17 << 20)
    assert len(warc.member(big, 1)) > len(big) and warc.member(big, 1)[-1] == 0 and gzip.decompress(warc.member(big, 1)) == big


def record(i, payload, kind="response"):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = hashlib.sha256(payload).hexdigest().encode()
    return (
        b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n"
        % (kind.encode(), i, digest, len(http) + len(payload)) + http + payload + b"\r\n\r\n"
    )


def read(data):
    """Ids of the records, and (offset, length) of the gaps, which with the records cover the file."""
    rows = list(warc.salvage(io.BytesIO(data), len(data)))
    at = 0
    for r in rows:
        assert r["offset"] == at
        at += r["length"]
    assert at == len(data)
    return [int(r["record_id"][10:-1]) for r in rows if "problem" not in r], [(r["offset"], r["length"], r["problem"]) for r in rows if "problem" in r]


@pytest.mark.parametrize("pack", [bytes, gzip.compress], ids=["plain", "members"])
def test_damage(pack):
    rnd = random.Random(5)
    parts = [pack(record(i, bytes(rnd.choices(b"abcd", k=rnd.randrange(100, 2000))))) for i in range(8)]
    starts = [sum(map(len, parts[:i])) for i in range(9)]
    whole = b"".join(parts)
    assert read(whole) == (list(range(8)), [])
    # a flipped bit anywhere in the middle of record 3
    for at in range(starts[3], starts[4], 97):
        bad = whole[:at] + bytes([whole[at] ^ 0x10]) + whole[at + 1 :]
        ids, gaps = read(bad)
        assert ids in ([0, 1, 2, 4, 5, 6, 7], list(range(8)))  # some bits of a header mean nothing
        assert [g[:2] for g in gaps] == ([(starts[3], len(parts[3]))] if len(ids) == 7 else [])
    # bytes missing, bytes too many, a cut end, a broken start, another file in between
    assert read(whole[: starts[3] - 60] + whole[starts[3] - 20 :])[0] == [0, 1, 3, 4, 5, 6, 7]
    junk = b"\x1f\x8b\x08WARC/1.0\r\nnothing" * 3
    assert read(whole[: starts[5]] + junk + whole[starts[5] :]) == (list(range(8)), [(starts[5], len(junk), read(junk)[1][0][2])])
    assert read(whole[:-3])[0] == list(range(7)) and read(whole[:-3])[1][0][0] == starts[7]
    assert read(whole[5:])[0] == list(range(1, 8))
    assert read(b"WARC/1.1\r\n\r\n")[1] == [(0, 12, "no length")]
    assert read(b"") == ([], []) and read(b"no archive") == ([], [(0, 10, "no version line")])
    # two damaged neighbours are one gap; zeros between records are one
    bad = bytearray(whole)
    bad[starts[2] + 2] ^= 1
    bad[starts[3] + 2] ^= 1
    assert read(bytes(bad))[0] == [0, 1, 4, 5, 6, 7] and len(read(bytes(bad))[1]) == 1
    assert read(whole[: starts[1]] + bytes(5000) + whole[starts[1] :])[1] == [(starts[1], 5000, "no version line")]


def test_members_with_several_records_and_mixtures():
    three = gzip.compress(b"".join(record(i, b"p" * i) for i in (1, 2, 3)))
    rows = list(warc.salvage(io.BytesIO(three + record(4, b"q")), len(three) + len(record(4, b"q"))))
    assert [r["record_id"] for r in rows] == [f"<urn:page:{i}>" for i in (1, 2, 3, 4)]
    broken = gzip.compress(record(1, b"p") + record(2, b"pp").replace(b"pp", b"qq") + record(3, b"ppp"))
    rows = list(warc.salvage(io.BytesIO(broken), len(broken)))
    assert [r.get("record_id", r.get("problem")) for r in rows] == ["<urn:page:1>", "payload digest differs", "<urn:page:3>"]
    assert warc._digest_holds("sha1:GVUTTPJCUQTGBPLDQGZTVUDOCB2ZCAEW", b"some") is False and warc._digest_holds("crc9:1", b"") is True


def test_gaps_are_logged_by_file(spark, tmp_path):
    parts = [gzip.compress(record(i, os.urandom(400))) for i in range(4)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts[:2]) + parts[2][:-4])
    (tmp_path / "y.warc.gz").write_bytes(b"".join(parts[3:]))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path))
    assert warc.records(rows).count() == 3
    gap = warc.quarantine(rows).collect()
    assert [(g["file"].rsplit("/", 1)[1], g["offset"], g["problem"]) for g in gap] == [("x.warc.gz", len(parts[0]) + len(parts[1]), "member is cut off")]


FOLDER = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    df = warc.op12_warc(spark, FOLDER)
    cursor = con.execute(warc.SQL)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cursor.fetchall())
