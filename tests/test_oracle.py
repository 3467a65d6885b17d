"""Every query of the engine against its SQL, run by DuckDB over the same tables."""

import math

import duckdb
import pytest

from tessella.plans import registry
from tessella.plans.derive import TABLES

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 7) if type(v).__name__ == "Decimal" else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    run = con.execute(registry.ORACLE_SQL[name])
    named = [d[0] for d in run.description]
    assert sorted(named) == cols
    want = [[r[named.index(c)] for c in cols] for r in run.fetchall()]
    assert ordered(got) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert registry.FLAGSHIP in e.queries()
