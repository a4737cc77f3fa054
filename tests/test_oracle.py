"""Every catalog query against its SQL in DuckDB on the driver's small tables."""

import duckdb
import pytest

from loomgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def norm(v):
    return round(v, 6) if isinstance(v, float) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    rel = con.sql(catalog.oracle_sql()[name])
    names = rel.columns
    assert sorted(names) == columns
    want = sorted(repr([norm(r[names.index(c)]) for c in columns]) for r in rel.fetchall())
    assert got == want


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_greedy_pack_skips_what_does_not_fit(spark):
    from loomgraph.operators import relational as R

    df = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (1, 4, 1), (2, 1, 500)], "g int, ord int, cost long")
    got = [(r["g"], r["ord"], r["place"]) for r in R.greedy_pack(df, ["g"], ["ord"], "cost", 100).collect()]
    assert sorted(got) == [(1, 1, 1), (1, 3, 2)]
    assert R.greedy_pack(df, ["g"], ["ord"], "cost", 100, most=1).count() == 1
