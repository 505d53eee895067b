"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from millrace.plans import catalog
from tests.compare import same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        same(df, SF, catalog.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["district", "chunk_id", "rank", "distance"]
    assert df.count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    """The scan reads the columns that are asked for, and filters at the source."""
    plan = catalog.QUERIES["optional_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan.split("PushedFilters")[1] and "EqualTo(lang,en)" in plan
    assert "text" not in plan.split("ReadSchema")[1]


def test_group_limit_is_partial(spark):
    plan = catalog.QUERIES["panel_semantic_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
