"""Every query with an SQL twin is held against it on the smallest driver tables."""

import duckdb
import pytest

from quarryline.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("~" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    got = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(found.select(*columns).collect()) == plain([tuple(r[i] for i in order) for r in got.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_others_give_rows(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() > 0


def test_flagship_is_registered(spark):
    import __spark_entry__ as e

    assert catalogue.FLAGSHIP in e.queries() and e.entry(spark).columns == ["event_id", "user_id", "n_candidates", "status"]
    assert set(e.oracle_sql()) <= set(e.queries())
