"""Every registered query against its oracle on the smallest tables."""

import math

import duckdb
import pytest

from lodestone import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((_plain([r[c] for c in names]) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(name, spark, sf, duck):
    got = plans.queries()[name](spark, sf).toArrow()
    if name in plans.oracle_sql():
        assert rows(got) == rows(duck.sql(plans.oracle_sql()[name]).to_arrow_table())
