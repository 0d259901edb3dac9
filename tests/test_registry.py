"""Every registered query: equal to its check SQL, and planned without nested loops or Python."""

import pytest

from checks import registry
from checks.compare import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, name)
    assert ok, note


@pytest.mark.parametrize(
    "name",
    [
        "serving", "spatial_left", "spatial_poly_poly", "contains_join", "spatial_anti", "flag_notices",
        "region_difference", "merge_sources", "orphan_geometries", "in_circles", "natural_left", "isr_summary",
    ],
)
def test_plan(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for node in ("NestedLoop", "Cartesian", "Python", "Pandas"):
        assert node not in plan


def test_every_query_has_check_sql():
    assert set(registry.ORACLES) == set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(registry.QUERIES)
    assert set(entry.oracle_sql()) >= set(registry.ORACLES)
