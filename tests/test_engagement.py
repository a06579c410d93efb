"""Metrics over interactions on a small fixture, worked out by hand."""

import datetime
from math import log

import pytest

from salesgrid import operators as O
from salesgrid.plans.model import CrmModel

D = datetime.date
T = datetime.datetime


@pytest.fixture(scope="module")
def model(spark):
    deals = spark.createDataFrame([
        ("o1", "x", "Won", D(2020, 1, 1), D(2020, 3, 1), 100), ("o2", "x", "Won", D(2020, 1, 1), D(2020, 6, 1), 50),
        ("o3", "y", "Won", D(2020, 1, 1), D(2020, 1, 10), 10), ("o4", None, "Won", D(2020, 1, 1), D(2020, 3, 1), 1),
        ("o5", "z", "Lost", D(2020, 1, 1), D(2020, 3, 1), 0), ("o6", "w", "Won", D(2020, 1, 1), D(2020, 3, 1), 30)],
        "opportunity_id string, account string, deal_stage string, engage_date date, close_date date, close_value int") \
        .selectExpr("opportunity_id", "account", "deal_stage", "engage_date", "close_date", "CAST(close_value AS DECIMAL(15,2)) AS close_value")
    contacts = spark.createDataFrame([
        ("x", 1, T(2020, 2, 1, 9), "view"), ("x", 2, T(2020, 2, 1, 9, 10), "click"), ("x", 3, T(2020, 2, 20), "signup"),
        ("x", 4, T(2020, 3, 1, 23), "purchase"), ("x", 5, T(2020, 5, 1), "error"), ("y", 6, T(2020, 2, 1), "view"),
        ("y", 7, T(2020, 2, 1), "click"), ("z", 8, T(2020, 2, 1), "purchase"), (None, 9, T(2020, 2, 1), "view"), ("y", 10, None, "view")],
        "account string, contact_id long, contact_time timestamp_ntz, channel string")
    accounts = spark.createDataFrame([("x", "tech", 1.0), ("y", "tech", 2.0), ("z", None, 3.0), ("w", "food", 4.0)],
                                     "account string, sector string, revenue double")
    return CrmModel.from_frames(deals, accounts, accounts, accounts, interactions=contacts, as_of="2020-12-31")


def test_funnel(model):
    got = [(r.step, r.channel, r.visitors, r.accounts, r.conversion_rate, r.step_rate) for r in O.funnel(model).collect()]
    assert got == [(1, "view", 3, 2, pytest.approx(200 / 3), pytest.approx(200 / 3)), (2, "click", 3, 2, pytest.approx(200 / 3), 100.0),
                   (3, "signup", 3, 1, pytest.approx(100 / 3), 50.0), (4, "purchase", 3, 1, pytest.approx(100 / 3), 100.0)]
    short = O.funnel(model, within_days=20).collect()
    assert [r.accounts for r in short] == [2, 2, 1, 0]      # the purchase is 29 days after the view
    by = {(r.sector, r.step): r.accounts for r in O.funnel(model, by="sector").collect()}
    assert by == {(None, 1): 0, (None, 2): 0, (None, 3): 0, (None, 4): 0, ("tech", 1): 2, ("tech", 2): 2, ("tech", 3): 1, ("tech", 4): 1}


def test_lead_conversion(model):
    assert [(r.sector, r.leads, r.customers, r.conversion_rate) for r in O.lead_conversion(model).collect()] \
        == [("tech", 2, 1, 50.0), (None, 1, 0, 0.0)]      # y bought before its first contact


def test_contact_to_purchase(model):
    got = {r.opportunity_id: tuple(r)[3:] for r in O.contact_to_purchase(model).collect()}
    assert got == {"o1": (D(2020, 2, 1), D(2020, 3, 1), "purchase", 29, 0), "o2": (D(2020, 2, 1), D(2020, 5, 1), "error", 121, 31),
                   "o3": (None,) * 5, "o4": (None,) * 5, "o6": (None,) * 5}


def test_contact_cycle(model):
    assert tuple(O.contact_cycle(model).first()) == (1, 29.0, 29, 29, 29.0)


def test_sessions(model):
    got = {r.account: tuple(r)[1:] for r in O.sessions(model).collect()}
    assert got == {"x": (5, 4, 1.25, 2.5), "y": (2, 1, 2.0, 0.0), "z": (1, 1, 1.0, 0.0)}
    assert {r.account: r.sessions for r in O.sessions(model, gap_minutes=5).collect()} == {"x": 5, "y": 1, "z": 1}


def test_scores(model):
    got = {r.account: r for r in O.full_health_score(model, half_life_days=100).collect()}
    assert set(got) == {"x", "y", "w"}
    days = {1: 334, 2: 334, 3: 315, 4: 305, 5: 244}
    w = {i: 0.5 ** (d / 100) for i, d in days.items()}
    rate_x, rate_y = sum(w[i] for i in (1, 2, 3, 4)), 2 * w[1]
    diversity_x, diversity_y = 100 * log(5) / log(5), 100 * log(2) / log(5)
    x, y, none = got["x"], got["y"], got["w"]
    assert x.norm_recency == 100 and x.norm_frequency == 100 and x.norm_monetary == 100
    assert x.norm_engagement == pytest.approx((100 + diversity_x) / 2)
    assert x.norm_support == pytest.approx(100 * (1 - w[5] / (rate_x + w[5])))
    assert y.norm_engagement == pytest.approx((100 * rate_y / rate_x + diversity_y) / 2) and y.norm_support == 100
    assert none.norm_engagement == 0 and none.norm_support == 100
    assert none.health_score == pytest.approx(0.3 * none.norm_recency + 0.2 * 50 + 0.2 * 20 + 0.1 * 100)
    only = {r.account: r.engagement_score for r in O.engagement_score(model, weights=(0, 0, 0, 1)).collect()}
    assert only == {"x": pytest.approx(diversity_x), "y": pytest.approx(diversity_y), "w": 0.0}


def test_models_without_interactions_say_so(fixture_model):
    with pytest.raises(ValueError, match="interactions"):
        O.funnel(fixture_model)


def test_no_contacts_at_all(spark, model):
    none = CrmModel.from_frames(model._pipeline, model.accounts(), model.accounts(), model.accounts(),
                                interactions=model.interactions().limit(0), as_of="2020-12-31")
    assert all(r.norm_engagement == 0 and r.norm_support == 100 for r in O.full_health_score(none).collect())
    assert O.sessions(none).collect() == [] and O.contact_cycle(none).first().customers == 0
    assert [r.accounts for r in O.funnel(none).collect()] == [0, 0, 0, 0]
