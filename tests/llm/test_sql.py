"""The queries of this package that SQL can express, against DuckDB over the same tables."""

import duckdb
import pytest

from tessella.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    run = con.execute(queries.ORACLE_SQL[name])
    named = [d[0] for d in run.description]
    assert sorted(named) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*named).collect()))) == sorted(map(str, run.fetchall()))


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)} and set(queries.QUERIES) | {"pipeline"} <= names
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
