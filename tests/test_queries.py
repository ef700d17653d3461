"""Every query against its SQL twin in DuckDB, and the driver's contract."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from lexispark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(name, spark, duck, sf_dir):
    got = registry.QUERIES[name](spark, sf_dir)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(got.columns)
    a, b = rows(got.columns, map(tuple, got.collect())), rows(columns, want.fetchall())
    assert a == b
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INTEGER"}
    types = {x[0]: str(x[1]) for x in duck.execute(f"DESCRIBE {registry.ORACLE_SQL[name]}").fetchall()}
    assert {c: kinds[t] for c, t in got.dtypes} == types


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["w", "score", "r"]
