"""Registered queries beside their SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest
from testtables import SF

from palimgraph import queries as graph

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()
def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


#: Their answer is no rows.
EMPTY = {"ranges_unsorted", "context_invalid", "context_magic_predicate", "same_variable"}


@pytest.mark.parametrize("name", graph.queries())
def test_query_equals_sql(spark, con, name):
    found = graph.queries()[name](spark, SF)
    cols = sorted(found.columns)
    wanted = con.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({graph.oracle_sql()[name]})")
    rows = plain(found.select(*cols).collect())
    assert rows == plain(wanted.fetchall())
    assert rows or name in EMPTY


def test_every_query_has_sql():
    assert set(graph.queries()) == set(graph.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(graph.queries()) <= set(__spark_entry__.queries())
