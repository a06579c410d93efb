"""Hand-computed results on the edge-case pipeline of FIXTURES.md §3."""

import math

import pytest


from salesgrid import operators as O
from salesgrid.plans.model import crm_view
from tests.conftest import rows_by


def close(a, b, tol=1e-6):
    return a is not None and math.isclose(a, b, rel_tol=0, abs_tol=tol)


def test_q0_view(fixture_model):
    rows = rows_by(crm_view(fixture_model), "opportunity_id")
    assert len(rows) == 8
    assert rows["O5"]["series"] is None
    assert rows["O6"]["sector"] is None and rows["O7"]["sector"] is None
    assert rows["O1"]["manager"] == "Dustin Brinkmann" and rows["O4"]["office_location"] == "Kenya"


def test_q1_average_order_value(fixture_model):
    assert O.average_order_value(fixture_model).first()[0] == 6662.5


def test_q2_clv(fixture_model):
    r = rows_by(O.customer_lifetime_value(fixture_model), "company_sold_to")
    a = r["Acme Corporation"]
    assert (a["avg_value_per_deal"], a["total_deals"]) == (300.0, 2)
    assert close(a["customer_lifespan_years"], 60 / 365)
    assert close(a["historical_clv"], 600) and close(a["annual_clv"], 3650)
    assert close(a["projected_3yr_clv"], 9984.710744)
    b = r["Betatech"]
    assert (b["avg_value_per_deal"], b["total_deals"], b["customer_lifespan_years"]) == (26000.0, 1, 0.0)
    assert close(b["annual_clv"], 26000) and close(b["projected_3yr_clv"], 71240)
    d = r["dambase"]
    assert close(d["historical_clv"], 50) and close(d["projected_3yr_clv"], 137)


def test_q3_acquisition(fixture_model):
    r = rows_by(O.acquisition_cost_proxy(fixture_model), "account")
    assert set(r) == {"Acme Corporation", "Betatech", "dambase"}
    a = r["Acme Corporation"]
    assert (a["avg_sales_cycle_days"], a["estimated_cac"], a["customer_lifetime_value"]) == (30.0, 3000.0, 600.0)
    assert close(a["clv_cac_ratio"], 0.2) and close(a["cac_payback_months"], 60)
    b = r["Betatech"]
    assert close(b["clv_cac_ratio"], 4.406780) and close(b["cac_payback_months"], 2.723077)
    d = r["dambase"]
    assert d["estimated_cac"] == 0 and d["clv_cac_ratio"] is None and d["cac_payback_months"] == 0


def test_q4_churn(fixture_model):
    rows = O.churn_status(fixture_model).collect()
    assert [(x.account, x.days_since_last_purchase, x.retention_status) for x in rows] == [
        ("dambase", 429, "Churned"), ("Acme Corporation", 379, "Churned"), ("Betatech", 45, "Active")]


def test_q5_q6_repeat(fixture_model):
    assert rows_by(O.purchase_counts(fixture_model), "account")["Acme Corporation"]["purchase_count"] == 2
    r = O.repeat_purchase_rate(fixture_model).first()
    assert (r.repeat_customers, r.total_customers) == (1.0, 3)
    assert close(r.repeat_purchase_rate, 33.333333)


def test_q7a_cohorts(fixture_model):
    rows = {(r.acquisition_year, r.acquisition_month): r.asDict()
            for r in O.cohort_retention(fixture_model).collect()}
    assert set(rows) == {(2017, 1), (2017, 2), (2018, 3)}
    assert rows[(2017, 1)]["month_0"] == 1 and rows[(2017, 1)]["month_3"] == 1
    assert sum(v for k, v in rows[(2017, 1)].items() if k.startswith("month_")) == 2
    for key in [(2017, 2), (2018, 3)]:
        assert rows[key]["cohort_size"] == 1 and rows[key]["month_0"] == 1
        assert sum(v for k, v in rows[key].items() if k.startswith("month_")) == 1


def test_q8_cohorts_long(fixture_model):
    rows = O.cohort_retention_long(fixture_model).collect()
    assert len(rows) == 3 * 6
    r = [x for x in rows if x.cohort == "2017-01" and x.month == 3][0]
    assert (r.active_customers, r.cohort_size, r.retention_rate) == (1, 1, 100.0)


def test_q7b_rfm(fixture_model):
    r = rows_by(O.rfm_segments(fixture_model), "account")
    a, b, d = r["Acme Corporation"], r["Betatech"], r["dambase"]
    assert (a["recency_days"], a["frequency"], a["monetary"], a["rfm_cell"], a["customer_segment"]) == \
        (379, 2, 600.0, "232", "Needs Attention")
    assert (b["rfm_cell"], b["customer_segment"]) == ("313", "Potential Loyalist")
    assert (d["rfm_cell"], d["customer_segment"]) == ("121", "Hibernating")


def test_q9_value_segments(fixture_model):
    r = rows_by(O.value_segments(fixture_model), "account")
    assert r["Acme Corporation"]["value_segment"] == "Regular Customers (Low Value)"
    assert r["Betatech"]["value_segment"] == "Big Spenders (Low Frequency)"
    assert r["dambase"]["value_segment"] == "Low Value (Growth Opportunity)"
    assert r["Betatech"]["sector"] == "medical" and r["Betatech"]["revenue"] == 647.18


def test_q10_q11_q12_conversion(fixture_model):
    r = O.deal_conversion(fixture_model).first()
    assert tuple(r) == (8, 4, 2, 50.0, 26650.0, 6662.5)
    s = rows_by(O.stage_conversion(fixture_model), "deal_stage")
    assert (s["Won"]["count"], s["Won"]["total_value"], s["Won"]["rank"]) == (4, 26650.0, 1)
    assert (s["Lost"]["count"], s["Engaging"]["count"], s["Prospecting"]["count"]) == (2, 1, 1)
    c = O.sales_cycle_stats(fixture_model).first()
    assert tuple(c) == (29.75, 0, 59, 30.0)


def test_q13_agents(fixture_model):
    r = rows_by(O.agent_performance(fixture_model), "sales_agent")
    assert r["Anna Snelling"]["regional_office"] == "Central" and r["Anna Snelling"]["won_deals"] == 2
    assert r["Carl Lin"]["win_rate"] == 0.0 and r["Carl Lin"]["avg_deal_size"] is None


def test_q14_q15_q16_products(fixture_model):
    p = rows_by(O.product_performance(fixture_model), "product")
    assert p["GTX Plus"]["series"] is None and p["MG Special"]["unique_customers"] == 1
    pen = rows_by(O.product_penetration(fixture_model), "product")
    assert set(pen) == {"GTX Basic", "MG Special", "GTK 500", "GTX Plus"}
    assert all(v["customers_with_product"] == 1 and v["total_customers"] == 3
               and close(v["penetration_rate"], 33.333333) for v in pen.values())
    x = O.cross_sell(fixture_model).first()
    assert (x.cross_sell_customers, x.total_customers, x.max_products_per_customer) == (1.0, 3, 2)
    assert close(x.cross_sell_rate, 33.333333) and close(x.avg_products_per_customer, 1.333333)


def test_q17_q18_markets(fixture_model):
    r = rows_by(O.industry_performance(fixture_model), "sector")
    m = r["medical"]
    assert (m["customer_count"], m["deal_count"], m["won_deals"], m["win_rate"], m["total_revenue"],
            m["avg_deal_size"], m["revenue_per_customer"]) == (2, 2, 1, 50.0, 26000.0, 26000.0, 26000.0)
    t = r["technolgy"]
    assert (t["customer_count"], t["deal_count"], t["won_deals"]) == (1, 3, 2)
    assert close(t["win_rate"], 66.666667) and (t["avg_deal_size"], t["revenue_per_customer"]) == (300.0, 600.0)
    n = r[None]
    assert (n["customer_count"], n["deal_count"], n["won_deals"], n["win_rate"], n["total_revenue"]) == (0, 2, 0, 0.0, 0.0)
    assert n["avg_deal_size"] is None and n["revenue_per_customer"] is None
    g = rows_by(O.geographic_performance(fixture_model), "office_location")
    assert g["Kenya"]["won_deals"] == 1 and g["United States"]["customer_count"] == 3


def test_q19_health(fixture_model):
    r = rows_by(O.health_score(fixture_model), "account")
    b, a, d = r["Betatech"], r["Acme Corporation"], r["dambase"]
    assert (b["norm_recency"], b["norm_frequency"], b["norm_monetary"]) == (100.0, 50.0, 100.0)
    assert close(b["health_score"], 85) and b["health_status"] == "Excellent"
    assert close(a["norm_recency"], 11.873351) and close(a["norm_monetary"], 2.307692)
    assert close(a["health_score"], 35.441648) and a["health_status"] == "At Risk"
    assert close(d["health_score"], 19.253497) and d["health_status"] == "Critical"


def test_q20_churn_risk(fixture_model):
    r = rows_by(O.churn_risk(fixture_model), "account")
    assert close(r["dambase"]["churn_risk_score"], 205.92) and r["dambase"]["churn_risk_level"] == "Very High Risk"
    assert close(r["Acme Corporation"]["churn_risk_score"], 133.764706)
    assert close(r["Betatech"]["churn_risk_score"], 0.992647) and r["Betatech"]["churn_risk_level"] == "Low Risk"


def test_q21_q22_profiles(fixture_model):
    c = rows_by(O.customer_360(fixture_model), "account")
    a = c["Acme Corporation"]
    assert (a["total_opportunities"], a["won_deals"], a["lifetime_value"], a["unique_products_purchased"]) == (3, 2, 600.0, 2)
    assert c["Condax"]["first_purchase_date"] is None and c["Condax"]["won_deals"] == 0
    t = O.touchpoints(fixture_model).collect()
    assert [x.account for x in t] == ["dambase", "Condax", "Acme Corporation", "Betatech", None]
    acme = [x for x in t if x.account == "Acme Corporation"][0]
    assert close(acme.avg_engagement_to_close_days, 23.333333)
    assert (acme.fastest_close_days, acme.longest_close_days, acme.unique_sales_agents,
            acme.unique_products_considered) == (10, 30, 2, 2)
    null = t[-1]
    assert null.avg_engagement_to_close_days is None and (null.unique_sales_agents, null.unique_products_considered) == (2, 1)


def test_q24_features(fixture_model):
    r = rows_by(O.account_features(fixture_model), "account")
    assert len(r) == 4
    a = r["Acme Corporation"]
    assert (a["company_age"], a["office_location"], a["completed_deals"], a["failed_deals"],
            a["total_deals"]) == (21, "US", 2.0, 1.0, 3.0)
    assert close(a["avg_days_close_deal"], 23.333333) and close(a["win_rate"], 0.666667)
    assert (r["Betatech"]["company_age"], r["Betatech"]["office_location"], r["Betatech"]["win_rate"]) == (31, "Non-US", 1.0)
    assert (r["Condax"]["company_age"], r["Condax"]["win_rate"], r["Condax"]["avg_days_close_deal"]) == (0, 0.0, 20.0)
    assert (r["dambase"]["company_age"], r["dambase"]["avg_days_close_deal"]) == (22, 0.0)


def test_q23_profile(fixture_model):
    prof = rows_by(O.column_profile(O.account_features(fixture_model)), "column")
    assert prof["account"]["count"] == 4 and prof["account"]["mean"] is None
    age = prof["company_age"]
    assert (age["min"], age["max"], age["mean"]) == (0.0, 31.0, 18.5)
    assert age["p50"] == 21.5 and age["p25"] == 15.75


def test_documented_formulas(fixture_model):
    d = rows_by(O.discounted_clv(fixture_model), "account")
    assert close(d["Betatech"]["discounted_clv"], 26000 * (1 / 1.1 + 1 / 1.1 ** 2 + 1 / 1.1 ** 3))
    pr = O.period_retention(fixture_model).collect()
    # 2017 buyers: Acme, dambase; 2018 buyers: Betatech -> retained 0, lost 2, new 1
    assert len(pr) == 1
    p = pr[0]
    assert (p.customers_start, p.customers_end, p.new_customers, p.retained_customers,
            p.lost_customers, p.retention_rate, p.churn_rate) == (2, 1, 1, 0, 2, 0.0, 1.0)
    pc = rows_by(O.predicted_clv(fixture_model, retention_rate=0.5), "account")
    assert close(pc["Betatech"]["predicted_clv"], 26000 * 0.5 / (1.1 - 0.5))
    ip = rows_by(O.industry_penetration(fixture_model), "sector")
    assert (ip["medical"]["customers"], ip["medical"]["addressable_accounts"]) == (1, 2)
    rr = rows_by(O.regional_ratio(fixture_model), "regional_office")
    assert close(rr["Central"]["revenue_share"], 26600 / 26650 * 100)
    assert close(rr["West"]["revenue_share"], 50 / 26650 * 100)


def test_unmatched_agent_keeps_its_name(spark, fixture_model):
    from salesgrid.plans.model import CrmModel
    extra = spark.createDataFrame(
        [("O9", "Ghost Agent", "GTX Basic", "Betatech", "Won", None, None, None)],
        fixture_model.pipeline().schema)
    m = CrmModel.from_frames(fixture_model.pipeline().unionByName(extra), fixture_model.accounts(),
                             fixture_model.products(), fixture_model.sales_teams(),
                             **fixture_model.params)
    r = rows_by(O.agent_performance(m), "sales_agent")
    assert r["Ghost Agent"]["manager"] is None and r["Ghost Agent"]["won_deals"] == 1
    t = rows_by(O.touchpoints(m), "account")
    assert t["Betatech"]["unique_sales_agents"] == 2
    rr = rows_by(O.regional_ratio(m), "regional_office")
    assert None in rr


def _frames(spark, deals):
    """A model of won deals (account, engage, close, value, product) of three accounts."""
    from salesgrid import CrmModel
    rows = [(str(i), "agent", p, a, "Won", e, c, v) for i, (a, e, c, v, p) in enumerate(deals)]
    pipeline = spark.createDataFrame(rows, "opportunity_id string, sales_agent string, product string, account string, "
                                           "deal_stage string, engage_date string, close_date string, close_value int")
    pipeline = pipeline.selectExpr("opportunity_id", "sales_agent", "product", "account", "deal_stage",
                                   "date(engage_date) engage_date", "date(close_date) close_date",
                                   "cast(close_value as decimal(15,2)) close_value")
    accounts = spark.createDataFrame([(a, "s", 1990, 1.0, 5, "X", None) for a in "abc"],
                                     "account string, sector string, year_established int, revenue double, "
                                     "employees int, office_location string, subsidiary_of string")
    products = spark.createDataFrame([("p", "s", 1.0)], "product string, series string, sales_price double")
    teams = spark.createDataFrame([("agent", "m", "o")], "sales_agent string, manager string, regional_office string")
    return CrmModel.from_frames(pipeline, accounts, products, teams)


def test_cohort_of_accounts_without_close_dates(spark):
    m = _frames(spark, [("a", "2017-01-01", None, 5, "p"), ("a", "2017-01-01", None, 5, "p"),
                        ("b", "2017-01-01", "2017-02-01", 5, "p"), ("c", "2017-01-01", "2017-02-03", 5, "p")])
    rows = {r.acquisition_year: r for r in O.cohort_retention(m).collect()}
    assert rows[None].cohort_size == 1 and rows[None].month_0 == 0
    assert rows[2017].cohort_size == 2 and rows[2017].month_0 == 2
    assert O.cohort_retention_long(m).filter("cohort is null").count() == 6
    assert dict(O.cohort_retention(m).dtypes)["month_12"] == "bigint"


def test_divisions_by_zero_give_null(spark):
    m = _frames(spark, [("a", "2017-01-01", "2017-02-01", 0, "p"), ("b", "2017-01-01", "2017-03-01", 0, "p")])
    rows = O.health_score(m, as_of="2018-01-01").collect()
    assert [r.norm_monetary for r in rows] == [None, None] and {r.health_status for r in rows} == {"Critical"}
    assert {r.predicted_clv for r in O.predicted_clv(m, discount_rate=0.0, retention_rate=1.0).collect()} == {None}


def test_health_score_needs_a_date(spark):
    with pytest.raises(ValueError, match="as_of"):
        O.health_score(_frames(spark, [("a", "2017-01-01", "2017-02-01", 1, "p")]))


@pytest.mark.parametrize("granularity,starts", [("quarter", ["2017-04-01", "2017-07-01", "2017-10-01"]),
                                                ("month", [f"2017-{m:02d}-01" for m in range(3, 11)])])
def test_retention_by_quarter_and_month(spark, granularity, starts):
    m = _frames(spark, [("a", None, "2017-02-10", 1, "p"), ("a", None, "2017-05-10", 1, "p"),
                        ("b", None, "2017-02-11", 1, "p"), ("b", None, "2017-10-01", 1, "p"),
                        ("c", None, "2017-05-30", 1, "p"), (None, None, "2017-05-30", 1, "p")])
    rows = O.period_retention(m, granularity=granularity).collect()
    assert [str(r.period_start) for r in rows] == starts
    if granularity == "quarter":
        assert [(r.customers_start, r.customers_end, r.new_customers, r.retained_customers, r.lost_customers)
                for r in rows] == [(2, 2, 1, 1, 1), (2, 0, 0, 0, 2), (0, 1, 1, 0, 0)]
    assert sum(r.retained_customers for r in rows) == (1 if granularity == "quarter" else 0)
    pooled = O.predicted_clv(m, granularity=granularity).first().retention_rate
    assert pooled == sum(r.retained_customers for r in rows) / sum(r.customers_start for r in rows)


def test_customer_360_with_a_hot_account(spark):
    deals = [("a", "2017-01-01", "2017-02-01", 1, f"p{i % 7}") for i in range(300)] + [("b", None, None, 2, None)]
    rows = {r.account: r for r in O.customer_360(_frames(spark, deals)).collect()}
    assert (rows["a"].total_opportunities, rows["a"].won_deals, rows["a"].unique_products_purchased,
            rows["a"].lifetime_value) == (300, 300, 7, 300.0)
    assert rows["b"].unique_products_purchased == 0


def test_no_won_deals_does_not_fail(spark, fixture_model):
    """Degenerate input: every operator still runs (no ANSI division errors, no
    empty-ranking failures) and reports what the SQL would."""
    from salesgrid.plans.model import CrmModel
    p = fixture_model.pipeline().filter("deal_stage <> 'Won'")
    m = CrmModel.from_frames(p, fixture_model.accounts(), fixture_model.products(),
                             fixture_model.sales_teams(), **fixture_model.params)
    assert O.average_order_value(m).first()[0] is None
    r = O.deal_conversion(m).first()
    assert (r.total_opportunities, r.won_deals, r.win_rate, r.avg_deal_size) == (4, 0, 0.0, None)
    assert O.cross_sell(m).count() == 0
    assert O.repeat_purchase_rate(m).first().repeat_purchase_rate is None
    for fn in (O.customer_lifetime_value, O.acquisition_cost_proxy, O.churn_status,
               O.cohort_retention, O.cohort_retention_long, O.rfm_segments, O.value_segments,
               O.health_score, O.churn_risk, O.product_penetration, O.period_retention,
               O.discounted_clv, O.predicted_clv):
        assert fn(m).count() == 0, fn.__name__
    assert O.sales_cycle_stats(m).first().median_sales_cycle_days is None
    for fn in (O.agent_performance, O.product_performance, O.industry_performance,
               O.geographic_performance, O.customer_360, O.touchpoints, O.industry_penetration,
               O.regional_ratio, O.stage_conversion):
        assert fn(m).count() > 0, fn.__name__


def test_view_joins_only_requested_dimensions(fixture_model):
    v = crm_view(fixture_model, ["opportunity_id", "account", "sector"])
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "accounts.csv" in plan and "products.csv" not in plan and "sales_teams.csv" not in plan
    assert {r.opportunity_id: r.sector for r in v.collect()}["O4"] == "medical"
