"""Every bound query against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from foliant import plans

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


#: Queries whose SQL orders windows, held against larger tables, too, where rows tie.
ORDERED = ["w10_merged_intervals", "u8_fact_intervals", "u9_relations", "w5_largest_gap", "w7_latest_order", "n_facts", "n_relations", "u11_merge_log", "s16_read_pages", "t15_cast"]


def connected(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    compare(spark, duck, name, FOLDER)


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_queries_where_rows_tie(spark, name):
    compare(spark, connected(LARGER), name, LARGER)


def compare(spark, duck, name, folder):
    df = plans.queries()[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted(names) == cols
    assert got == want
