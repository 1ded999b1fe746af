"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from checks import MODULES

ORACLES = entry.oracle_sql()
QUERIES = {name: query for name, query in entry.queries().items() if any(name in module.QUERIES for module in MODULES)}


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
