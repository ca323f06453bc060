"""Versions of late sessions against a fold over the batches, and the SQL on the smallest tables."""

import os
import random
from collections import Counter

import pytest

from quarry.llm import sessions

COLUMNS = ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "value_sum", "retracted_batch", "retracted_start_s"]


def brute(events, gap):
    """Versions of (user, at, batch, value) by going through the batches."""
    out = []
    for user in {e[0] for e in events}:
        own = [e for e in events if e[0] == user]
        standing = []  # rows of out that nothing has retracted
        for batch in sorted({e[2] for e in own}):
            groups = []
            for e in sorted((e for e in own if e[2] <= batch), key=lambda e: e[1]):
                if groups and e[1] - groups[-1][-1][1] <= gap:
                    groups[-1].append(e)
                else:
                    groups.append([e])
            for g in groups:
                new = sum(e[2] == batch for e in g)
                if new:
                    start, end = g[0][1], g[-1][1]
                    inside = [v for v in standing if start <= v[2] <= end]
                    for v in inside:
                        v[8:] = [batch, start]
                    standing = [v for v in standing if v not in inside]
                    out.append([user, batch, start, end, len(g), new, len(inside), sum(e[3] or 0 for e in g), None, None])
                    standing.append(out[-1])
    return Counter(map(tuple, out))


def versions(spark, rows, gap, extra=""):
    df = spark.createDataFrame(rows, "user long, at long, batch long, value long" + extra).repartition(3)
    return Counter(tuple(r[c] for c in COLUMNS) for r in sessions.session_versions(df, gap=gap).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_equal_a_fold(spark, seed):
    rnd = random.Random(seed)
    rows = [(u, t := rnd.randrange(-500, 4000 * u), t // 300 + rnd.choice([0, 0, 1, 5]), rnd.randrange(9)) for u in range(1, 6) for _ in range(60)]
    rows += rows[:10]  # repeated rows count one by one
    assert versions(spark, rows, 40) == brute(rows, 40)


def test_a_user_who_never_stops_costs_no_square(spark):
    rows = [(7, t, t // 200 + (3 if t % 17 == 0 else 0), 1) for t in range(0, 40_000, 5)]
    assert versions(spark, rows, 20) == brute(rows, 20)
    runs = sessions._runs(spark.createDataFrame(rows, "user long, at long, batch long, value long"), 20)
    placed = sessions._placed(runs, 20)
    batches = len({r[2] for r in rows})
    assert sessions._snapshots(placed, 20).count() < 4 * placed.count() * batches.bit_length()


def test_defined_cases(spark):
    rows = [(1, 5, 0, None, "a", 1), (1, 5, 0, 2, "b", 2), (None, 5, 0, 1, "c", 3), (1, None, 0, 1, "d", 4), (1, 6, None, 1, "e", 5), (1, 100, 4, 3, "f", 6)]
    clash = ", chunk string, island int"
    want = {(1, 0, 5, 5, 2, 2, 0, 2, None, None): 1, (1, 4, 100, 100, 1, 1, 0, 3, None, None): 1}
    assert versions(spark, rows, 10, clash) == want
    assert versions(spark, [], 10) == Counter()
    assert versions(spark, [r[:4] for r in rows[:2]] * 500, 10)[(1, 0, 5, 5, 1000, 1000, 0, 1000, None, None)] == 1


FOLDER = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    df = sessions.op11_late_sessions(spark, FOLDER)
    cursor = con.execute(sessions.SQL)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cursor.fetchall())
