"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import connect, spark_rows, sql_rows
from hard_tables import write_hard_tables
from tillscope.plans.oracles import ORACLES
from tillscope.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["generated", "hard"])
def folder(request, tmp_path_factory):
    """The smallest generated tables, and tables with NULLs and hot keys."""
    if request.param == "generated":
        return SMALL
    return write_hard_tables(tmp_path_factory.mktemp("hard"))


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_names_agree():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, folder, connection, name):
    df = QUERIES[name](spark, folder)
    names, expected = sql_rows(connection, ORACLES[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == expected
