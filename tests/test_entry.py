"""The driver's contract."""

import __spark_entry__ as entry


def test_registry_names_and_oracles():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert "r61c_free_text" in queries


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
