"""Every registered query against DuckDB."""

import pytest

from pinweave.plans import registry


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_same_rows(name, spark, sf_dir, matches):
    matches(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_rows(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["cn", "tv", "tm", "msm", "msv", "msrv"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
