"""Every query of the core against its SQL, at the smallest scale."""

import pytest

import compare
from attestry.plans import registry

TABLES = {}


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_query_equals_sql(spark, folder, name):
    if "con" not in TABLES:
        TABLES["con"] = compare.duck(folder)
    ok, said = compare.compare(spark, TABLES["con"], folder, name)
    assert ok, said


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.sql())))
def test_query_runs(spark, folder, name):
    df = registry.queries()[name](spark, folder)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()
