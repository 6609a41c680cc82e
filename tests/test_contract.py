"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.plans import all_oracles, all_queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{float(x):.5f}"
    return str(x)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_oracle(spark, duck, name):
    df = all_queries()[name](spark, DIR)
    cols = sorted(df.columns)
    cur = duck.execute(all_oracles()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    assert got == want and got, name


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
