"""The trie of conversations against a brute-force one, and the SQL on the smallest tables."""

import hashlib
import os
import random
import zlib
from collections import Counter

import pytest

from quarry.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, splice):
    """Nodes of (conv, turn, role, text) rows without ties."""
    convs = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((r or "", x or ""))
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if splice else 0
        whole[c] = tuple(convs.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = Counter()
    children = Counter(k[:-1] for k in members if k)
    below = {}
    for k in members:
        for d in range(len(k) + 1):
            below.setdefault(k[:d], []).append(k)
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == k)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below[k] if x)
        out[min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], sum(not children[x] for x in below[k]), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def nodes(spark, rows, splice, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string" + extra).repartition(3)
    return Counter(tuple(r[c] for c in COLUMNS) for r in P.prefix_trie(df, splice=splice).collect())


def conversations(seed, n, spread):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        here = c * spread
        rows += [(here, t, rnd.choice(["user", "a"]) if t > 3 else "user", rnd.choice(["x", "yü", "", "zzz"])) for t in range(rnd.randrange(1, 8))]
    return rows


@pytest.mark.parametrize("splice", [False, True])
def test_nodes_equal_brute_force(spark, monkeypatch, splice):
    monkeypatch.setattr(P, "ENDS", 64)  # ends of one node in several chunks
    rows = conversations(4, 90, 7) + [(100 + c, t, "user", "same") for c in range(7, 12) for t in range(1)]
    assert nodes(spark, rows, splice) == brute(rows, splice)


def test_long_and_equal_conversations(spark, monkeypatch):
    """Shared depths far over a block, a conversation that is numbered in ranges, and many equal ones."""
    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "LONG", 30)
    rows = [(c, t, "user", f"turn {t % 5}") for c in (1, 2, 3) for t in range(57 + c)] + [(3, 100 + t, "a", "own") for t in range(5)]
    rows += [(c, t, "user", "turn 0" if t == 0 else "equal") for c in range(300, 700) for t in range(3)]
    rows += [(900, None, None, None)]
    assert nodes(spark, rows, False) == brute(rows, False)


def test_defined_cases(spark):
    rows = [(5, None, None, None), (5, 1, "user", None), (6, 0, "user", "a"), (None, 0, "user", "b"), (-107, 0, "user", "a")]
    assert nodes(spark, [(*r, "x", "y") for r in rows], False, ", node string, depth string") == brute(rows, False)
    assert nodes(spark, [(*r, "x", "y") for r in rows if r[0] is None or r[0] > 0], True, ", conv string, total string") == brute([r for r in rows if r[0] is None or r[0] > 0], True)
    assert nodes(spark, [], True) == Counter()
    twice = nodes(spark, [(1, 0, "user", "t")] * 2, False)  # repeated rows are turns of their own
    assert sorted((k[1], k[3]) for k in twice) == [(0, 1), (1, 1), (2, 1)]
    long = "word " * 300_000
    assert sum(k[6] for k in nodes(spark, [(1, 0, "user", long), (2, 0, "user", long)], False)) == 2 * len(long)


FOLDER = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    df = P.op13_prefix_trie(spark, FOLDER)
    cursor = con.execute(P.SQL)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cursor.fetchall())
