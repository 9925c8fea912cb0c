"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import pytest

from tests.conftest import SF
from tidewater.plans import archives, catalogue  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain([r[c] for c in columns] for r in df.collect()) == plain([r[i] for i in at] for r in found.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_a_query_is_registered_once():
    with pytest.raises(ValueError):
        catalogue.query()(catalogue.QUERIES["q_argmax"])
