"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest
from oracle import connection, rows

from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, folder, name):
    mine = rows(catalog.queries()[name](spark, folder).toPandas())
    other = rows(connection(folder).execute(catalog.oracle_sql()[name]).fetch_df())
    assert mine == other


def test_every_query_has_columns(spark, folder):
    for name, query in catalog.queries().items():
        assert query(spark, folder).columns, name
