import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from querysieve.plans.queries import QUERIES, SQL


def plain(value):
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [plain(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()]
    if name in SQL:
        found = duck.execute(SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        want = [plain(tuple(dict(zip(columns, r))[c] for c in sorted(columns))) for r in found.fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
