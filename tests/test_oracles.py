"""Every registered query beside its SQL, on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from loomcorpus import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(plans.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, DIR).count() > 0
