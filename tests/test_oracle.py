"""Every registered query against its SQL."""

import pytest

import workload.all  # noqa: F401
from workload.registry import QUERIES, SQL


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


def canon(rows):
    return sorted((tuple(map(rounded, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(SQL[name])
    theirs = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    columns = sorted(df.columns)
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert canon(df.select(*columns).collect()) == canon([r[i] for i in at] for r in expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
