"""Every registered query runs at the smallest scale and equals its SQL where it has some."""

import pytest

import __spark_entry__ as entry
from scriptorium.plans import catalog
from tests.parity import compare, duck


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE_SQL:
        assert compare(df, duck(sf), catalog.ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["met12_sweep", "ret12_weighted", "ret13_hybrid", "sec01_sections"])
def test_unions_under_the_default_setting(spark, name):
    """Other sessions may let a union pass for partitioned; rows must be the same."""
    kept, sf = spark.conf.get("spark.sql.unionOutputPartitioning"), "/root/testdata/sf0.01"
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    try:
        assert compare(catalog.QUERIES[name](spark, sf), duck(sf), catalog.ORACLE_SQL[name]) == ""
    finally:
        spark.conf.set("spark.sql.unionOutputPartitioning", kept)
