"""Every registered query against the same query in another engine, at the smallest scale."""

import math

import duckdb
import pytest

from siltstone.plans import common, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in common.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (list, tuple)):
        return f"[{','.join(map(norm, v))}]"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_integer_ratio"):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", registry.queries())
def test_matches_the_other_engine(spark, other, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.toArrow().to_pylist())
    if name not in registry.oracle_sql():
        assert got
        return
    cursor = other.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= registry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()
