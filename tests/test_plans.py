"""Physical-plan properties that matter at scale."""

import os

import pytest

import __spark_entry__ as E
from salesgrid import operators as O

from .test_oracle import crm_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data missing")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def model(spark):
    return E.model_for(spark, SF)


def test_no_python_udfs_in_relational_operators(spark, model):
    for fn in (O.customer_lifetime_value, O.industry_performance, O.cohort_retention,
               O.product_performance, O.customer_360, O.period_retention):
        p = plan(fn(model))
        assert "PythonUDF" not in p and "EvalPython" not in p, fn.__name__


@pytest.fixture
def steps(monkeypatch):
    """Plans of all eager steps: what is checkpointed no longer shows in the final plan."""
    from salesgrid import session
    from salesgrid.operators import (clustering, engagement, features, hierarchy, market, product, profile, repeat_buying,
                                     retention, segmentation, survival, value)
    from salesgrid.plans import ranking
    seen = []

    def recorded(df):
        seen.append(plan(df))
        return session.reliable_checkpoint(df)

    for module in (clustering, engagement, features, hierarchy, market, product, profile, repeat_buying, retention, segmentation,
                   survival, value, ranking):
        if hasattr(module, "reliable_checkpoint"):
            monkeypatch.setattr(module, "reliable_checkpoint", recorded)
    return seen


def test_stage_filter_reaches_the_scan(model):
    p = plan(O.churn_status(model, sort=False))
    pushed = [x.split("]")[0] for x in p.split("PushedFilters: [")[1:]]
    assert any("l_returnflag" in x for x in pushed)


def test_unused_dimensions_are_not_joined(model):
    # stage metrics read lineitem only; no orders/customer/supplier scan
    p = plan(O.stage_conversion(model, sort=False))
    assert "orders" not in p and "customer" not in p and "supplier" not in p
    p = plan(O.customer_lifetime_value(model, sort=False))
    assert "supplier" not in p and "part.parquet" not in p


def test_scan_reads_only_needed_columns(model):
    p = plan(O.deal_conversion(model))
    schema = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "l_returnflag" in schema and "l_extendedprice" in schema
    assert "l_partkey" not in schema and "l_shipdate" not in schema


def test_dimension_joined_after_aggregation(model):
    # sector metric: the fact table is aggregated by account before the accounts join
    p = plan(O.industry_performance(model, sort=False))
    join_at = p.find("Join")
    assert p.find("HashAggregate", join_at) != -1


# Not one plan: fits and reports read their own checkpointed tables many times.
ML = {"elbow", "cluster_profile", "cluster_sector_mix", "cluster_sector_crosstab", "cluster_sector_shares",
      "cluster_pca", "pca_explained_variance", "feature_matrix", "feature_matrix_long", "cluster_audit"}


def planned_queries():
    """The queries of the library, with one for all that are built alike (each builds its tables first)."""
    alike = {n for n in crm_queries() if n.endswith("_from_state") or n.startswith("csv_")}
    return {k: v for k, v in crm_queries().items() if k not in alike - {"churn_status_from_state", "csv_products"}}


# Of stored tables or interactions alone: no scan of the deals is left in the plan.
NO_FACTS = {"funnel", "funnel_by_sector", "sessions", "account_hierarchy", "stored_view",
            *(f"csv_{t}" for t in ("accounts", "products", "sales_pipeline", "sales_teams")),
            *(n for n in E.queries() if n.endswith("_from_state"))}
# The as-of join reads its left side for the cells and for the rows; the audit compares with two exact answers.
MORE_FACTS = {"contact_to_purchase": 2, "approx_audit": 3}
# Row-level results and name checks: they need the name of every deal's account.
BY_NAME = {"crm_view", "contact_to_purchase", "relation_orphans", "approx_audit"}


def test_fact_table_read_once(spark, steps):
    for name, fn in planned_queries().items():
        if name in ML:
            continue
        steps.clear()
        final = plan(fn(spark, SF))
        n = sum(p.count("lineitem.parquet") for p in [*steps, final])
        expected = 0 if name in NO_FACTS else MORE_FACTS.get(name, 1)
        assert n == expected or name == "industry_penetration" and n <= 1, f"{name} scans the fact table {n} times"


def test_no_single_task_stage_over_unbounded_input(spark, steps):
    """Planned without broadcasts: a single-partition exchange may only feed a global partial
    aggregate (one row per task), per-partition offset counts, or an aggregate over a small domain."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    allowed = ("HashAggregate(keys=[], functions=[partial_", "ObjectHashAggregate(keys=[], functions=[partial_",
               "SortAggregate(key=[], functions=[partial_", "HashAggregate(keys=[_part", "HashAggregate(keys=[deal_stage", "HashAggregate(keys=[regional_office",
               "HashAggregate(keys=[period")
    try:
        for name, fn in planned_queries().items():
            if name in ML:
                continue
            steps.clear()
            final = plan(fn(spark, SF))
            for lines in (p.splitlines() for p in [*steps, final]):
                for i, line in enumerate(lines):
                    if "Exchange SinglePartition" in line:
                        child = next(x for x in lines[i + 1:] if "Project" not in x)
                        assert any(a in child for a in allowed), f"{name}: {child.strip()[:120]}"
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_accounts_are_named_after_aggregation(spark, model, steps):
    """Without broadcasts, orders are not shuffled to the customers: only aggregated rows are."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, fn in planned_queries().items():
            if name in ML | BY_NAME:
                continue
            steps.clear()
            final = plan(fn(spark, SF))
            for p in [*steps, final]:
                assert "hashpartitioning(o_custkey" not in p, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_distinct_counts_without_row_copies(model, steps):
    """customer_360 and touchpoints: no Expand, and fact rows never meet the agents' table."""
    for fn in (O.customer_360, O.touchpoints):
        steps.clear()
        final = plan(fn(model, sort=False))
        assert all("Expand" not in p for p in [*steps, final])
        assert all("supplier" not in p for p in steps if "lineitem" in p)


def test_one_sort_for_all_quintiles(model, steps):
    O.rfm_segments(model, sort=False)
    assert sum("rangepartitioning" in p for p in steps) == 1


def test_cohort_month0_covers_cohort(model):
    # every account's first purchase falls in its month 0
    rows = O.cohort_retention(model, sort=False).collect()
    assert rows and all(r.month_0 >= r.cohort_size > 0 for r in rows)
    distinct = O.cohort_retention(model, distinct_customers=True, sort=False).collect()
    assert all(r.month_0 == r.cohort_size for r in distinct)


def test_registered_queries_have_no_row_caps(spark):
    # every registered query runs over whole tables: no LIMIT / top-k anywhere in its plan
    for name, fn in planned_queries().items():
        if name in ("elbow", "pca_explained_variance", "cluster_audit"):
            continue          # built from fitted-model summaries, not a scan plan
        p = plan(fn(spark, SF))
        for op in ("GlobalLimit", "LocalLimit", "CollectLimit", "TakeOrderedAndProject", "Sample"):
            assert op not in p, f"{name}: {op}"


@pytest.fixture
def no_broadcasts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def shuffled(p, key):
    """What each exchange by the key moves: the lines below it down to the next Project."""
    lines = p.splitlines()
    return ["".join(lines[i + 1:next(j for j in range(i + 1, len(lines)) if "Project" in lines[j]) + 1])
            for i, line in enumerate(lines) if f"Exchange hashpartitioning({key}#" in line]


def test_order_shuffle_moves_days_and_values(spark, no_broadcasts):
    """Deals meet their orders with stage, day and value, not with the wider columns that these come from."""
    p = plan(E.queries()["crm_view"](spark, SF))
    (moved,) = shuffled(p, "l_orderkey")
    kept = moved.split("Project [")[1].split("]")[0]
    for made in ("_stage", "_shipped", "_value"):
        assert f"AS {made}#" in kept
    (orders,) = {x for x in shuffled(p, "o_orderkey")}
    assert "AS _ordered#" in p and "o_orderdate" not in orders.split("Project [")[1].split("]")[0].replace("cast(o_orderdate", "")


def test_stored_view_shuffles_no_more_than_it_must(spark, no_broadcasts):
    """The accounts' attributes and the teams' columns do not travel through the shuffles for other dimensions."""
    rows = [("o1", "s1", "p1", "a1"), ("o2", "s2", "p9", None), ("o2", None, "p1", "a2"), ("o2", None, "p1", "a2")]
    facts = spark.createDataFrame(rows, "opportunity_id string, sales_agent string, product string, account string") \
        .selectExpr("*", "'Won' deal_stage", "DATE'2020-01-01' engage_date", "DATE'2020-02-01' close_date", "1.0BD close_value")
    teams = spark.createDataFrame([("s1", "m", "r")], "sales_agent string, manager string, regional_office string")
    products = spark.createDataFrame([("p1", "x", 5.0)], "product string, series string, sales_price double")
    accounts = spark.createDataFrame([("a1", "it", 1990, 1.0, 3, "US", None), (None, "no", 0, 0.0, 0, "XX", None)],
                                     "account string, sector string, year_established int, revenue double, employees int, "
                                     "office_location string, subsidiary_of string")
    from salesgrid.plans.model import CrmModel, crm_view
    view = crm_view(CrmModel.from_frames(facts, accounts, products, teams))
    logical = view._jdf.queryExecution().optimizedPlan().toString()
    joins = [x.split("(")[1].split("#")[0] for x in logical.splitlines() if "Join LeftOuter" in x]
    assert joins == ["sales_agent", "account", "product"]          # the outermost first
    got = sorted((r.opportunity_id, r.manager or "", r.series or "", r.sector or "") for r in view.collect())
    assert got == [("o1", "m", "x", "it"), ("o2", "", "", ""), ("o2", "", "x", ""), ("o2", "", "x", "")]
