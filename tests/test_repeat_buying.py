"""The repeat-purchase model: likelihood by enumeration, planted parameters, per-account output."""

import datetime
import itertools
import math

import numpy as np
import pytest

from salesgrid.operators import repeat_buying as R
from salesgrid.plans.model import CrmModel


def simulate(rng, n, alpha, beta, gamma, delta, most=24, least=12):
    """(repeats, last, observed) of customers drawn from the model."""
    out = []
    for _ in range(n):
        p, q, observed = rng.beta(alpha, beta), rng.beta(gamma, delta), int(rng.integers(least, most + 1))
        x = last = 0
        for t in range(1, observed + 1):
            if rng.random() < q:
                break
            if rng.random() < p:
                x, last = x + 1, t
        out.append((x, last, observed))
    return out


def _beta(a, b):
    return math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))


def test_likelihood_against_enumerated_histories():
    """Sum over all purchase strings: every string's probability by integration over its possible drop-out months."""
    m = R.RepeatBuying(0.8, 1.7, 0.6, 3.0)
    n = 6
    total = 0.0
    for string in itertools.product((0, 1), repeat=n):
        x, last = sum(string), max([i + 1 for i, s in enumerate(string) if s], default=0)
        p = 0.0
        for alive in range(last, n + 1):        # months the customer was there
            bought = _beta(0.8 + x, 1.7 + alive - x) / _beta(0.8, 1.7)
            stayed = _beta(0.6, 3.0 + n) / _beta(0.6, 3.0) if alive == n else _beta(1.6, 3.0 + alive) / _beta(0.6, 3.0)
            p += bought * stayed
        one = [np.array([v]) for v in (x, last, n)]
        assert m.log_likelihood(*one)[0] == pytest.approx(math.log(p), abs=1e-10)
        total += p
    assert total == pytest.approx(1.0, abs=1e-10)


def test_predictions_against_simulation():
    rng = np.random.default_rng(5)
    pars = (1.2, 2.0, 0.7, 6.0)
    m = R.RepeatBuying(*pars)
    seen = {}
    for _ in range(300_000):
        p, q = rng.beta(pars[0], pars[1]), rng.beta(pars[2], pars[3])
        gone = rng.geometric(q)             # the month before which the customer leaves
        buys = rng.random(14) < p
        months = [t for t in range(1, 15) if t < gone and buys[t - 1]]
        early = [t for t in months if t <= 8]
        key = len(early), max(early, default=0)
        s = seen.setdefault(key, [0, 0, 0])
        s[0] += 1
        s[1] += gone > 9
        s[2] += len(months) - len(early)
    for (x, last), (n, alive, later) in seen.items():
        if n > 4000:
            cell = np.array([x]), np.array([last]), np.array([8])
            assert m.alive(*cell)[0] == pytest.approx(alive / n, abs=0.03)
            assert m.expected(*cell, 6)[0] == pytest.approx(later / n, rel=0.06, abs=0.02)
    cell = np.array([2]), np.array([3]), np.array([8])
    assert m.expected(*cell, 6, 0.01)[0] < m.expected(*cell, 6)[0]


def test_fit_recovers_planted_parameters(spark):
    rng = np.random.default_rng(7)
    planted = (1.2, 2.4, 0.9, 7.0)
    rows = spark.createDataFrame(simulate(rng, 40_000, *planted), "repeats long, last long, observed long")
    m = R.fit(R.histogram(rows))
    assert m.alpha / (m.alpha + m.beta) == pytest.approx(planted[0] / sum(planted[:2]), rel=0.03)
    assert m.gamma / (m.gamma + m.delta) == pytest.approx(planted[2] / sum(planted[2:]), rel=0.10)
    for got, want in zip((m.alpha, m.beta, m.gamma, m.delta), planted):
        assert got == pytest.approx(want, rel=0.35)


def deals_of(spark, rng, histories, value):
    rows = []
    for i, (x, last, observed) in enumerate(histories):
        start = 2020 * 12 + 11 - observed
        later = sorted(rng.choice(np.arange(1, last), x - 1, replace=False).tolist()) + [last] if x else []
        for m in (0, *later):
            ym = start + m
            rows.append((f"o{len(rows)}", f"a{i:04}", "Won", datetime.date(ym // 12, ym % 12 + 1, 5), round(float(value(i)), 2)))
    frame = spark.createDataFrame(rows, "opportunity_id string, account string, deal_stage string, close_date date, v double")
    deals = frame.selectExpr("opportunity_id", "account", "deal_stage", "close_date", "close_date AS engage_date", "CAST(v AS DECIMAL(15,2)) AS close_value")
    accounts = frame.select("account").distinct()
    return CrmModel.from_frames(deals, accounts, accounts, accounts, as_of="2020-12-20")


def test_history_and_output_per_account(spark):
    rng = np.random.default_rng(9)
    histories = simulate(rng, 800, 1.2, 2.4, 0.9, 7.0)
    scale = rng.gamma(6.0, 20.0, 800)
    model = deals_of(spark, rng, histories, lambda i: rng.gamma(4.0, scale[i] / 4.0) + 0.01)
    rows = {r.account: r for r in R.expected_clv(model).collect()}
    assert [(rows[f"a{i:04}"].repeats, rows[f"a{i:04}"].last, rows[f"a{i:04}"].observed) for i in range(800)] == histories
    assert all(0 < r.p_alive <= 1 and r.expected_purchases >= 0 and r.expected_clv > 0 for r in rows.values())
    recent = max(rows.values(), key=lambda r: (r.last - r.observed, r.repeats))
    idle = min(rows.values(), key=lambda r: (r.last - r.observed, r.repeats))
    assert recent.p_alive > idle.p_alive and recent.expected_purchases > idle.expected_purchases
    # the expected value lies between the account's own mean and that of all, nearer to its own with more months
    got = np.array([rows[f"a{i:04}"].expected_value for i in range(800)])
    assert np.corrcoef(got, scale)[0, 1] > 0.7 and got.std() < scale.std() * 1.2


def test_spend_moments(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(4000):
        n, own = int(rng.integers(1, 9)), rng.gamma(10.0, 10.0)
        z = rng.gamma(5.0, own / 5.0, n)
        rows.append((f"a{i}", round(float(z.sum()), 2), n, float((z * z).sum())))
    s = R.fit_spend(spark.createDataFrame(rows, "account string, _sum double, valued long, _squares double"))
    assert s.mean == pytest.approx(100, rel=0.03) and s.shape == pytest.approx(5.0, rel=0.1) and s.spread == pytest.approx(0.1, rel=0.2)


def test_edges(spark):
    model = deals_of(spark, np.random.default_rng(0), [(0, 0, 0), (1, 3, 5), (0, 0, 5)], lambda i: 10.0)
    rows = R.expected_clv(model, fitted=R.RepeatBuying(1, 1, 1, 5)).collect()
    assert len(rows) == 3 and all(r.expected_value == pytest.approx(10.0) for r in rows)
    empty = CrmModel.from_frames(model._pipeline.limit(0), model.accounts(), model.accounts(), model.accounts(), as_of="2020-12-20")
    with pytest.raises(ValueError):
        R.expected_clv(empty)


def test_simplex_search():
    f = lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2
    assert R.minimise(f, np.array([-1.0, 1.0]), tolerance=1e-14) == pytest.approx([1.0, 1.0], abs=1e-3)
