import math

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _same(a, b):
    return all(math.isclose(x, y, abs_tol=1e-8) or (math.isnan(x) and math.isnan(y)) if isinstance(x, float) and isinstance(y, int | float) else x == y for x, y in zip(a, b, strict=True))


def test_entry(spark, sf):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "membership_score" in df.columns


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _names():
    from concord.plans.round_trips import ORACLE

    return sorted(ORACLE)


@pytest.mark.parametrize("name", _names())
def test_query_gives_the_rows_of_its_sql(spark, sf, db, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    sql = db.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({__spark_entry__.oracle_sql()[name]})")
    want = sorted((tuple(r) for r in sql.fetchall()), key=repr)
    assert len(got) == len(want) and all(_same(a, b) for a, b in zip(got, want, strict=True))
