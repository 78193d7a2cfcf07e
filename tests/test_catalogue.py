import os
from decimal import Decimal

import pytest

from lodefuse.plans import catalogue

HERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(row):
    """A row as text: numbers that are equal read alike, whatever their type."""
    return str(tuple(float(x) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x for x in row))


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{HERE}/{t}.parquet')")
    got = catalogue.queries()[name](spark, HERE)
    columns = sorted(got.columns)
    want = con.execute(catalogue.oracle_sql()[name])
    at = [x[0] for x in want.description]
    assert sorted(at) == columns
    rows = [tuple(r[at.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted(plain(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(plain, rows))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["listing_id", "rrf"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
