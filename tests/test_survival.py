"""Hazards and churn probabilities: life table by hand and by brute force, no look-ahead, calibration on planted data."""

import datetime
import math
import random

import pytest

from salesgrid.operators import survival as V
from salesgrid.plans.model import CrmModel


def model_of(spark, months, as_of="2020-12-15"):
    """A model whose accounts have one won deal in each of their (year, month)s."""
    rows = [(f"o{i}", a, "Won", datetime.date(y, m, 3)) for i, (a, y, m) in enumerate(months)]
    deals = spark.createDataFrame(rows, "opportunity_id string, account string, deal_stage string, close_date date") \
        .selectExpr("*", "close_date AS engage_date", "CAST(1 AS DECIMAL(15,2)) AS close_value")
    accounts = spark.createDataFrame([(a, "s") for a in sorted({r[1] for r in rows if r[1]})], "account string, sector string")
    return CrmModel.from_frames(deals, accounts, accounts, accounts, as_of=as_of)


def simulate(rng, n, hazard, first=2015 * 12, until=2020 * 12 + 11):
    """Accounts that buy in a month with a probability that depends on the months since the last purchase and their number."""
    out = []
    for i in range(n):
        ym = first + rng.randrange(24)
        out.append((f"a{i:04}", ym))
        last, seen = ym, 1
        for m in range(ym + 1, until + 1):
            if rng.random() < hazard(m - last, seen):
                out.append((f"a{i:04}", m))
                last, seen = m, seen + 1
    return [(a, ym // 12, ym % 12 + 1) for a, ym in out]


def test_life_table_by_hand(spark):
    m = model_of(spark, [("x", 2020, 1), ("x", 2020, 3), ("x", 2020, 3), ("y", 2020, 9), ("z", 2020, 12), (None, 2020, 1)])
    got = [(r.frequency_class, r.month, r.at_risk, r.purchases, r.hazard) for r in V.hazard_table(m).collect()]
    # x: 2 months to the second, then 9 censored; y: 3 censored; z: bought this month, no spell
    assert got == [(1, 1, 2, 0, 0.0), (1, 2, 2, 1, 0.5), (1, 3, 1, 0, 0.0), *[(2, t, 1, 0, 0.0) for t in range(1, 10)]]
    survival = {(r.frequency_class, r.month): r.survival for r in V.hazard_table(m).collect()}
    assert survival[1, 1] == 1.0 and survival[1, 2] == pytest.approx(0.5) and survival[2, 9] == 1.0


def test_life_table_against_every_account_month(spark):
    rng = random.Random(1)
    months = simulate(rng, 60, lambda t, s: 0.25 / t)
    m = model_of(spark, months)
    risk, bought = {}, {}
    own = {}
    for a, y, mm in months:
        own.setdefault(a, set()).add(12 * y + mm - 1)
    for active in own.values():
        active = sorted(active)
        for i, start in enumerate(active):
            stop = active[i + 1] if i + 1 < len(active) else 2020 * 12 + 11
            c = max(k for k in V.CLASSES if k <= i + 1)
            for t in range(1, stop - start + 1):
                risk[c, t] = risk.get((c, t), 0) + 1
                bought[c, t] = bought.get((c, t), 0) + (i + 1 < len(active) and start + t == stop)
    got = {(r.frequency_class, r.month): (r.at_risk, r.purchases) for r in V.hazard_table(m).collect()}
    assert got == {k: (risk[k], bought[k]) for k in risk}


def test_nothing_after_the_date_is_used(spark):
    rng = random.Random(2)
    months = simulate(rng, 80, lambda t, s: 0.3 / t)
    early = [r for r in months if 12 * r[1] + r[2] - 1 <= 2018 * 12 + 5]
    for f in (V.hazard_table, V.churn_probability):
        assert f(model_of(spark, months), as_of="2018-06-30").collect() == f(model_of(spark, early), as_of="2018-06-30").collect()
    all_months, known = (V.active_months(model_of(spark, x)) for x in (months, early))
    assert V.fit_hazard(V.spells(all_months, 2018 * 12 + 5)) == V.fit_hazard(V.spells(known, 2018 * 12 + 5))


def test_probability_from_the_table(spark):
    m = model_of(spark, [("x", 2020, 1), ("x", 2020, 3), ("y", 2020, 9), ("z", 2020, 12)])
    got = {r.account: (r.seen, r.idle, r.churn_probability) for r in V.churn_probability(m, horizon=2).collect()}
    assert got["z"] == (1, 0, pytest.approx(0.5)) and got["y"] == (1, 3, 1.0) and got["x"] == (2, 9, 1.0)
    certain = model_of(spark, [("x", 2020, 10), ("x", 2020, 11), ("x", 2020, 12), ("y", 2020, 11), ("y", 2020, 12)])
    assert all(r.churn_probability == 1.0 or r.churn_probability == 0.0 for r in V.churn_probability(certain).collect())


def test_fit_finds_the_planted_hazard(spark):
    def true(t, seen):
        return 1 / (1 + math.exp(-(-0.4 - 1.1 * math.log(t) + 0.3 * math.log(seen))))

    months = simulate(random.Random(3), 3000, true)
    h = V.fit_hazard(V.spells(V.active_months(model_of(spark, months)), 2020 * 12 + 11))
    assert abs(h.intercept + 0.4) < 0.1 and abs(h.month + 1.1) < 0.1 and abs(h.seen - 0.3) < 0.1
    p = {(r.seen, r.idle): r.churn_probability for r in V.churn_probability(model_of(spark, months), horizon=3, hazard=h).collect()}
    for (seen, idle), q in p.items():
        want = math.prod(1 - 1 / (1 + math.exp(-(h.intercept + h.month * math.log(idle + k) + h.seen * math.log(seen)))) for k in (1, 2, 3))
        assert q == pytest.approx(want)


def test_later_period_is_predicted_better_than_by_the_base_rate(spark):
    months = simulate(random.Random(4), 2500, lambda t, s: min(0.9, 0.5 * s ** 0.3 / t ** 1.2))
    rows = {r.bin: r for r in V.backtest(model_of(spark, months), horizon=4).collect()}
    total = rows[None]
    assert total.log_loss < 0.9 * total.base_log_loss
    assert abs(total.predicted - total.churned) < 0.03
    for r in rows.values():
        if r.accounts > 100:
            assert abs(r.predicted - r.churned) < 0.07, r
    assert sum(r.accounts for b, r in rows.items() if b is not None) == total.accounts


def test_no_deals_and_nothing_to_learn(spark):
    empty = model_of(spark, [("x", 2020, 1)])
    none = CrmModel.from_frames(empty._pipeline.limit(0), empty.accounts(), empty.accounts(), empty.accounts(), as_of="2020-12-15")
    assert V.hazard_table(none).collect() == [] and V.churn_probability(none).collect() == []
    with pytest.raises(ValueError):
        V.fit_hazard(V.spells(V.active_months(empty), 2020 * 12 + 11))
    with pytest.raises(ValueError):
        V.backtest(none)
