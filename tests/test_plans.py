"""Physical plans: pushdown, pruning, no cartesian joins, no single-task series."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from voltmill.operators import features, marts
from voltmill.plans import load_queries

QUERIES = load_queries()
LAZY = [
    name
    for name in QUERIES
    if not name.startswith("stream_")
    and name not in ("bronze_stream", "published_documents", "table_profile", "isolation_forest", "layered_incidents",
                     "candidate_metrics", "forecast_evaluation", "recursive_forecast", "batch_scoring",
                     "portfolio_challenger")
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_products(spark, name):
    plan = plan_of(QUERIES[name].run(spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["lineitem_quantiles"].run(spark, SMALL)
    text = plan._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in text


def test_filters_reach_the_scan(spark):
    from voltmill.sources.tables import read_table

    df = read_table(spark, f"{SMALL}/lineitem.parquet").filter(F.col("l_quantity") > 49).select("l_orderkey")
    assert "GreaterThan(l_quantity,49.0)" in plan_of(df)


def test_feature_windows_are_keyed_by_chunk(spark, tables):
    plan = plan_of(features.build_features(tables.silver))
    assert "hashpartitioning(asset_id" in plan
    windows = [line for line in plan.splitlines() if "Window [" in line and "lag(" in line]
    assert windows and all("_chunk" in line for line in windows)


def test_hourly_mart_counts_assets_without_expand(spark, tables):
    assert "Expand" not in plan_of(marts.portfolio_hourly(tables.silver))
