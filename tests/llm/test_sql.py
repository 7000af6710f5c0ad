"""Queries with SQL against DuckDB, and the guard around this subpackage."""

import comparing
import pytest
from pathlib import Path

from tessera.llm import registry

ROOT = Path(__file__).resolve().parents[2]

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = comparing.database(SMALL)
    assert comparing.differences(registry.QUERIES[name](spark, SMALL), con, registry.ORACLE_SQL[name]) == []


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tessera").parts:
            assert "tessera.llm" not in path.read_text(), path
