"""The queries against their SQL twins in DuckDB, on the whole small tables."""

from collections import Counter

import duckdb
import pytest

from lexispark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(got.columns)
    assert Counter(want.fetchall()) == Counter(map(tuple, got.select(*columns).collect()))
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}
    types = {x[0]: str(x[1]) for x in con.execute(f"DESCRIBE {queries.ORACLE_SQL[name]}").fetchall()}
    assert {c: kinds[t] for c, t in got.dtypes} == types


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin_of_an_empty_table(name):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    assert len(con.execute(queries.ORACLE_SQL[name]).fetchall()) == (name == "op7_chat_format")
