"""Operators over the narrow fact table equal the same metric written in Spark SQL
over the registered four-way ``crm_data`` view (S6/S8)."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from salesgrid import operators as O
from salesgrid.plans import ranking
from salesgrid.sources import catalog


@pytest.fixture(scope="module")
def views(spark, fixture_model):
    catalog.register_views(fixture_model, prefix="eq_")
    return spark


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=repr), sorted(b, key=repr)):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert math.isclose(u, v, rel_tol=1e-12, abs_tol=1e-12)
            else:
                assert u == v


def test_agent_performance_equals_view_sql(views, fixture_model):
    sql = views.sql("""
        SELECT sales_agent, manager, regional_office,
               COUNT(opportunity_id) AS total_opportunities,
               COUNT(CASE WHEN deal_stage = 'Won' THEN 1 END) AS won_deals,
               COUNT(CASE WHEN deal_stage = 'Lost' THEN 1 END) AS lost_deals,
               CAST(COUNT(CASE WHEN deal_stage = 'Won' THEN 1 END) AS DOUBLE) * 100.0D
                 / CAST(NULLIF(COUNT(*), 0) AS DOUBLE) AS win_rate
        FROM eq_crm_data GROUP BY sales_agent, manager, regional_office""").collect()
    op = O.agent_performance(fixture_model).select(
        "sales_agent", "manager", "regional_office", "total_opportunities", "won_deals",
        "lost_deals", "win_rate").collect()
    _same([tuple(r) for r in sql], [tuple(r) for r in op])


def test_industry_performance_equals_view_sql(views, fixture_model):
    sql = views.sql("""
        SELECT sector, COUNT(DISTINCT account) AS customer_count,
               COUNT(opportunity_id) AS deal_count,
               CAST(SUM(CASE WHEN deal_stage = 'Won' THEN close_value ELSE 0 END) AS DOUBLE)
                 AS total_revenue
        FROM eq_crm_data GROUP BY sector""").collect()
    op = O.industry_performance(fixture_model).select(
        "sector", "customer_count", "deal_count", "total_revenue").collect()
    _same([tuple(r) for r in sql], [tuple(r) for r in op])


def test_acquisition_two_cte_form_equals_fused(views, fixture_model):
    sql = views.sql("""
        WITH sc AS (SELECT account, AVG(DATEDIFF(close_date, engage_date)) AS d
                    FROM eq_crm_data WHERE deal_stage = 'Won' GROUP BY account),
             cv AS (SELECT account, CAST(SUM(close_value) AS DOUBLE) AS v
                    FROM eq_crm_data WHERE deal_stage = 'Won' GROUP BY account)
        SELECT cv.account, sc.d, cv.v FROM cv JOIN sc ON cv.account = sc.account""").collect()
    op = O.acquisition_cost_proxy(fixture_model).select(
        "account", "avg_sales_cycle_days", "customer_lifetime_value").collect()
    _same([tuple(r) for r in sql], [tuple(r) for r in op])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=4), min_size=1, max_size=60),
       st.integers(min_value=1, max_value=7))
def test_ntile_property(spark, values, tiles):
    df = spark.createDataFrame([(f"a{i:03d}", v) for i, v in enumerate(values)], "account string, v long")
    got = {r.account: r.t for r in ranking.add_ntiles(df, "account", {"t": F.col("v")}, tiles,
                                                      partitions=3).collect()}
    w = Window.orderBy(F.col("v").asc_nulls_last(), F.col("account").asc_nulls_last())
    want = {r.account: r.t for r in df.withColumn("t", F.ntile(tiles).over(w)).collect()}
    assert got == want
