"""Every registered query with SQL against DuckDB, on the smallest tables; the others by what must hold."""

import comparing
import pytest

from tessera.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return comparing.database(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, database, name):
    assert comparing.differences(registry.QUERIES[name](spark, SMALL), database, registry.ORACLE_SQL[name]) == []


def test_bfr_keeps_every_point(spark):
    points = spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    last = max(registry.QUERIES["bfr_rounds"](spark, SMALL).collect(), key=lambda r: r.round_id)
    assert last.nof_point_discard + last.nof_point_compression + last.nof_point_retained == points


def test_entry_has_every_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
