import __spark_entry__ as E
from murmuration.plans import catalog


def test_entry_has_rows(spark):
    got = E.entry(spark)
    assert "coordination_score" in got.columns and got.count() > 0


def test_every_query_of_the_library_has_sql():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert not set(catalog.QUERIES) - set(E.oracle_sql())
