"""Every query with SQL against DuckDB on the smallest tables, where these are present."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from quarry import plans  # noqa: E402

FOLDER = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{round(float(v), 6) + 0.0:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_oracle(spark, oracle, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())
    cursor = oracle.execute(plans.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted("|".join(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_run(spark, name):
    df = plans.QUERIES[name](spark, FOLDER)
    assert df.count() > 0
