"""Every registered patch query against its SQL in DuckDB, on the small tables."""

import math

import duckdb
import pytest

from tessera.plans import registry

TABLES = "customer documents embeddings events labels".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, sf, name):
    df = registry.queries()[name](spark, sf)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert {k: TYPES[t] for k, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rows = want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in rows)
    assert got


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, sf, name):
    rows = registry.queries()[name](spark, sf).collect()
    assert rows
    if name == "train_and_vote":
        assert {r["vote"] for r in rows} <= {0, 1} and len({r["key"] for r in rows}) == len(rows)


def test_patch_part_stands_alone():
    import subprocess
    import sys

    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; assert 'rank_slides' in e.queries() and 'pipeline' not in e.queries(); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
