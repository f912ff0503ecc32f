"""Every query with SQL gives the rows of that SQL; the others run and have rows."""

import duckdb
import pytest

from gridloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(str(tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(catalog.oracle_sql()[name])
    assert cols == sorted(want.columns)
    assert canonical(tuple(r) for r in df.select(cols).collect()) == canonical(want.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    first = catalog.queries()[name](spark, SF)
    assert first.count() > 0
