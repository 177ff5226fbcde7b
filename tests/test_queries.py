"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle import compare, duck_connection

import __spark_entry__ as entry
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
# At this scale these have no rows to compare; they are checked at sf0.01.
MAY_BE_EMPTY = {"l1_market_list_filtered", "l3_market_page_asc", "l3_market_page_desc", "l4_search_stocks",
                "w15_zzr_screen_page"}


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, name, SF)
    if result == "both empty" and name in MAY_BE_EMPTY:
        return
    assert result is None, result
