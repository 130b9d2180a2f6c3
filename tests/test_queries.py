"""Every registered query against its SQL, at the smallest scale."""

import pytest

from corpusloom.plans.registry import collected
from tests.oracle import duck, rows

QUERIES, SQL = collected()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    found = rows(QUERIES[name](spark, sf_dir))
    if name in SQL:
        assert found == duck(sf_dir, SQL[name])
    else:
        assert found[1]


def test_entry(spark):
    import __spark_entry__ as registry

    assert registry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
    assert set(registry.oracle_sql()) <= set(registry.queries())
