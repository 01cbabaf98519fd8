"""Every query with reference SQL gives the same rows, over the whole smallest tables."""

import os

import duckdb
import pytest

from tesserae.plans.oracle import ORACLE
from tesserae.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return connection


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in found]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    made = QUERIES[name](spark, DATA)
    ran = duck.execute(ORACLE[name])
    names = [d[0] for d in ran.description]
    assert sorted(made.columns) == sorted(names)
    assert rows(made.columns, [tuple(r) for r in made.collect()]) == rows(names, ran.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
